"""Quality classifier by importance resampling (operator 9).

Two generative models count hashed word unigrams and bigrams: the *target*
model over the labelled good documents, the *raw* model over all documents.  A
document's log importance weight is the sum over its n-grams of the log ratio
of the two models.  Adding Gumbel noise and taking the top k draws k documents
without replacement in proportion to their weights; the others are rejected.

k is the share of good documents among the labelled ones, of all documents.
The noise is a hash of doc_id, so runs agree.  The k-th largest key is found
exactly by counting keys digit by digit; no ranking of the corpus takes place.

Target documents are a bounded sample, TARGET_DOCS labelled ones with the
smallest hashes of their ids; the raw counts, the scores and k cover all rows.
What reaches the driver has BUCKETS rows, or 65,536 for a digit.

Defined results: null, empty and blank texts have no n-gram and weight 0; a
text of one word has no bigram; equal keys go by the smaller doc_id; a null
doc_id is a value of its own; without labels everything is kept; rows that
repeat are kept or rejected alike; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import in_batches, table, written

BUCKETS = 1 << 14
TARGET_DOCS = 20_000
SEED = 20_240


def ngram_buckets(text: str | None) -> np.ndarray:
    """Bucket of every unigram and bigram of a text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def log_ratios(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """Per bucket the log ratio of the target to the raw model, both smoothed by one."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(target_docs)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.bincount(ngram_buckets(text), minlength=BUCKETS)
                raw += counts
                if own:
                    target += counts
        used = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    parts = marked.select("text", F.col("good_id").isNotNull().alias("good")).mapInArrow(in_batches(counted, 512), "bucket long, raw long, target long")
    sums = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for row in sums:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if not sum(row["target"] for row in sums):
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weight(text: Column, ratios: np.ndarray) -> Column:
    """Log importance weight of a text."""

    @F.pandas_udf("double")
    def weighed(texts: pd.Series) -> pd.Series:
        return pd.Series([float(ratios[ngram_buckets(t)].sum()) for t in texts], dtype="float64")

    return weighed(text)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise, a function of the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def _digits(key: Column) -> Column:
    """The key as a whole number of 60 bits that sorts alike: microunits, shifted to be positive."""
    return F.rint(F.greatest(F.least(key, F.lit(5e11)), F.lit(-5e11)) * 1e6).cast("long") + F.lit(1 << 59)


def kth_largest(rows: DataFrame, k: int) -> tuple[int, int] | None:
    """(digits, doc_id) of the k-th of ``rows`` (digits, doc_id) by digits descending, doc_id ascending."""
    if k <= 0:
        return None
    prefix, left = 0, k
    for shift in (45, 30, 15, 0):
        some = rows.where(F.shiftright("digits", shift + 15) == prefix).groupBy(F.shiftright("digits", shift).alias("d")).count()
        for row in sorted(some.collect(), key=lambda r: -r["d"]):
            if row["count"] >= left:
                prefix = row["d"]
                break
            left -= row["count"]
    # among equal keys the ids decide, again digit by digit
    equal = rows.where(F.col("digits") == prefix).select((F.coalesce("doc_id", F.lit(-(1 << 62))) + F.lit(1 << 62)).alias("id"))
    place = 0
    for shift in (48, 32, 16, 0):
        # a shift by 64 is none: the first digit takes all rows
        some = (equal.where(F.shiftright("id", shift + 16) == place) if shift < 48 else equal).groupBy(F.shiftright("id", shift).alias("d")).count()
        for row in sorted(some.collect(), key=lambda r: r["d"]):
            if row["count"] >= left:
                place = row["d"]
                break
            left -= row["count"]
    return prefix, place - (1 << 62)


class Resampler:
    """The fitted models and the bar that the chosen documents reach."""

    def __init__(self, docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS):
        self.ratios = log_ratios(docs, labels, target_docs)
        share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), log_weight(F.col("text"), self.ratios).alias("log_weight"))
        self.scores = written(own.withColumn("digits", _digits(F.col("log_weight") + gumbel(F.col("doc_id")))), "quality-scores")
        self.k = self.scores.count() if share is None else round(share * self.scores.count())
        self.bar = kth_largest(self.scores.select("digits", "doc_id"), self.k)

    def kept(self, digits: Column, doc_id: Column) -> Column:
        if self.bar is None:
            return F.lit(False)
        bar, last = self.bar
        return (digits > bar) | ((digits == bar) & (F.coalesce(doc_id, F.lit(-(1 << 62))) <= last))


def keep_good(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> DataFrame:
    """The documents drawn.  They are scored again where they lie, so none of them moves."""
    model = Resampler(docs, labels, target_docs)
    doc_id = F.col("doc_id").cast("long")
    return docs.where(model.kept(_digits(log_weight(F.col("text"), model.ratios) + gumbel(doc_id)), doc_id))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and decision for every document of ``documents``, trained on ``labels``."""
    model = Resampler(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return model.scores.select("doc_id", F.round("log_weight", 6).alias("log_weight"), model.kept(F.col("digits"), F.col("doc_id")).alias("kept"))


QUERIES = {"op9_quality": op9_quality}
#: Hashed n-gram models are beyond SQL: tests compare with brute force and held-out labels.
SQL: dict[str, str] = {}
