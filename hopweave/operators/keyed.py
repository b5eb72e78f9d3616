"""Keyed stores: caches with last-write-wins, resume, hits and misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the largest by ``order``, nulls smallest; combined in each task before rows move."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order])).alias("__row"))
    return best.select("__row.*")


def upsert(store: DataFrame, rows: DataFrame, key: str = "key", stamp: str = "created_at") -> DataFrame:
    """The store after an insert-or-replace; among equal stamps the larger value wins."""
    both = store.unionByName(rows.select(*store.columns))
    return last_wins(both, key, [stamp, *(c for c in store.columns if c not in (key, stamp))])


def lookup(requests: DataFrame, store: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Requests with the stored value and the column ``hit``."""
    return requests.join(store.select(key, value), key, "left").withColumn("hit", F.col(value).isNotNull())


def misses(requests: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Each missing key once."""
    return requests.join(store.select(key), key, "left_anti").dropDuplicates([key])


def unwrap_summary(value: Column) -> Column:
    """A cached value: the field ``summaries`` of a JSON object, any other text as it is."""
    return F.coalesce(F.get_json_object(value, "$.summaries"), value)


def cached_list(value: Column, schema: str, most: int) -> Column:
    """The first entries of a cached JSON list; null for broken JSON."""
    return F.slice(F.from_json(value, schema), 1, most)


def fresh(store: DataFrame, cached_at: str, ttl_seconds: float | None = None) -> DataFrame:
    """Entries younger than a time to live; without one all stay."""
    return store if ttl_seconds is None else store.where(F.unix_seconds(F.current_timestamp()) - F.col(cached_at) <= ttl_seconds)


def hit_stats(looked_up: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate) of looked-up requests."""
    counts = looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return counts.withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def pending(samples: DataFrame, results: DataFrame, key: str = "id", retry_errors: bool = False) -> DataFrame:
    """Samples without a result; a failed one counts as done unless errors are retried."""
    done = results.where(F.coalesce("error", F.lit("")) == "") if retry_errors else results
    return samples.join(done.select(F.col("sample_id").alias(key)), key, "left_anti")
