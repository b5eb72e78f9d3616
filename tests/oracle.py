"""Compares a query with its SQL in DuckDB over the same tables."""

import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.tolist() if hasattr(value, "tolist") else value


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        path = f"{folder}/{file}"
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows_of(frame) -> tuple[list[str], list[str]]:
    names = sorted(frame.columns)
    return names, sorted(repr(tuple(plain(row[c]) for c in names)) for row in frame.collect())


def expected(con, sql: str) -> tuple[list[str], list[str]]:
    relation = con.sql(sql)
    names = sorted(relation.columns)
    places = [relation.columns.index(c) for c in names]
    return names, sorted(repr(tuple(plain(row[i]) for i in places)) for row in relation.fetchall())
