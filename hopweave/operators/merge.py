"""Distinct with first wins, merges of duplicate candidates, tagged unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions.text import norm_entity


def first_wins(rows: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """One row a key: the first by ``order``.

    A grouped minimum, combined in each task before rows move, where a window
    would sort every key's rows.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key.alias("__key")).agg(F.min_by(whole, F.col(order)).alias("__row")).select("__row.*")


def frequency(edges: DataFrame) -> DataFrame:
    """Per (src, dst) of (src, dst, relation, ord): how many claims hit it, and the first relation."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("frequency"), F.min_by("relation", "ord").alias("relation"))


def merge_candidates(rows: DataFrame, most_sources: int = 8, most_evidence: int = 1000) -> DataFrame:
    """Merges candidates of (src, ord, entity, description, evidence, sources) by normalised name.

    The first row's name stays, the first non-empty description wins, sources
    are joined in order up to a number, and evidence is appended where it is
    not contained yet, up to a length.
    """
    grouped = rows.groupBy("src", norm_entity(F.col("entity")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("ord", "entity", "description", "evidence", "sources"))).alias("all"))
    descriptions = F.filter(F.transform("all", lambda r: r["description"]), lambda d: d.isNotNull() & (d != ""))
    texts = F.filter(F.transform("all", lambda r: r["evidence"]), lambda e: e.isNotNull() & (e != ""))
    joined = F.aggregate(texts, F.lit(""), lambda done, e: F.when(F.contains(done, e), done).when(done == "", e).otherwise(F.concat(done, F.lit(" "), e)))
    return grouped.select(
        "src",
        "name",
        F.col("all")[0]["entity"].alias("entity"),
        F.coalesce(F.get(descriptions, F.lit(0)), F.lit("")).alias("description"),
        F.left(joined, F.lit(most_evidence)).alias("evidence"),
        F.slice(F.flatten(F.transform("all", lambda r: r["sources"])), 1, most_sources).alias("sources"),
        F.size("all").cast("long").alias("merged"),
    )


def federated(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of all sources, each tagged with its name; missing columns are null."""
    tagged = [rows.withColumn("source", F.lit(name)) for name, rows in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_source(results: DataFrame, priority: list[str]) -> DataFrame:
    """Per query the rows of the first source in ``priority`` that has any."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    best = results.where(rank > 0).groupBy("query").agg(F.min(rank).alias("__best"))
    return results.join(best, "query").where(rank == F.col("__best")).drop("__best")
