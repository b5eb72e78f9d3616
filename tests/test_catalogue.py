"""Every query of the catalogue against its SQL, and the entry points."""

import pytest
from oracle import database, expected, rows_of

import __spark_entry__
from hopweave.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, con, name):
    assert rows_of(catalogue.QUERIES[name](spark, SF)) == expected(con, catalogue.SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dom_text(spark):
    rows = catalogue.QUERIES["html_text_dom"](spark, SF).collect()
    assert rows and all("track(0)" not in (r["text"] or "") for r in rows)


def test_leak_sanitize_reads_the_whole_text(spark):
    rows = {r["doc_id"]: r["masked"] for r in catalogue.QUERIES["leak_sanitize"](spark, SF).collect()}
    for r in catalogue.read(spark, SF, "documents").collect():
        year = 1200 + r["doc_id"] % 900
        whole = None if r["text"] is None else r["text"] + str(year)
        assert rows[r["doc_id"]] == (whole if whole is None or year >= 2030 else whole.replace(str(year), "[YEAR]"))


def test_entity_in_question_searches_all_names(spark, con):
    sql = catalogue.SQL["entity_in_question"].replace("FROM documents WHERE doc_id % 50 = 0", "FROM documents")
    assert rows_of(catalogue.QUERIES["entity_in_question"](spark, SF)) == expected(con, sql)
