"""URL filter by a Bloom filter cascade (operator 6).

The key universe of the corpus is known, so the cascade is exact: level 1
encodes the listed keys, level 2 the unlisted keys that level 1 lets through by
mistake, level 3 the listed ones that level 2 lets through, and so on until
nothing passes by mistake.  A key is judged by the first level it fails, or by
the last level if it fails none; no join with the list takes place.

Keys are cut into shards of a bounded number of bits.  Filters enter the plan
as scalar subqueries, as many shards at once as fit CASCADE_BYTES; a larger
cascade takes one pass over the rows for each such group of shards, in which
the rows of these shards are judged.  Only DataFrame functions are used.

Rules (host, path prefix) go first: a rule fits its host and all subdomains if
the path starts with the rule's; the longest wins.

Defined results: null urls and urls without ``://`` have an empty host and
path, which fit no rule and whose key is the empty one; pages that share a key
share the verdict; an empty list or an empty universe allows everything; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import table, written

#: Fixed rules of the query: host, path prefix, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BITS_PER_KEY, HASHES = 12, 4
#: Listed keys a shard is planned for: at most 2^17 words of 64 bits a level.
SHARD_KEYS = 500_000
#: Filters that are one value of the plan: at least one shard, or as many as fit.
CASCADE_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for own, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, own + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


class Cascade:
    """Exact membership of keys in a list, over a universe of keys."""

    def __init__(self, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, shard_keys: int = SHARD_KEYS, cascade_bytes: int = CASCADE_BYTES):
        """``universe``: (key, listed), one row a key."""
        spark = universe.sparkSession
        listed = universe.where("listed").count()
        self.shards = max(1, -(-listed // shard_keys))
        left = universe.select("key", "listed", self._shard(F.col("key")).alias("shard"))
        self.words: list[int] = []
        self.bytes = cascade_bytes
        levels = []
        encode = True
        while True:
            members = left.where(F.col("listed") == encode)
            most = members.groupBy("shard").count().agg(F.max("count")).first()[0]
            if not most:
                break
            level, words = len(levels), 1 << max(0, (most * bits_per_key - 1).bit_length() - 6)
            self.words.append(words)
            marks = members.select("shard", F.explode(F.array(*self._bits(F.col("key"), level))).alias("bit"))
            set_bits = marks.select("shard", (F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 AS INT))").alias("mask"))
            blank = spark.range(self.shards * words).select((F.col("id") / words).cast("int").alias("shard"), (F.col("id") % words).cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
            filled = set_bits.union(blank).groupBy("shard", "word").agg(F.bit_or("mask").alias("mask"))
            arrays = filled.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("filter"))
            levels.append(written(arrays.withColumn("level", F.lit(level)), "bloom-level"))
            fooled = left.where(F.col("listed") != encode)
            fits = lambda rows, words, level=level: rows.where(self._passes(F.col("key"), words, level))
            passing = self._by_group(fooled, F.col("shard"), levels[-1], "filter", words, fits)
            # the next level has to encode what passes by mistake and to spare what this level encodes
            left = written(passing.unionByName(members.select("key", "listed", "shard")), "bloom-keys")
            encode = not encode
        self.depth = len(levels)
        self.filters = None
        if levels:
            stacked = levels[0]
            for more in levels[1:]:
                stacked = stacked.unionByName(more)
            own = F.transform(F.array_sort(F.collect_list(F.struct("level", "filter"))), lambda x: x["filter"])
            self.filters = written(stacked.groupBy("shard").agg(own.alias("filters")), "bloom-cascade")

    def _by_group(self, rows: DataFrame, shard: Column, filters: DataFrame, column: str, words: int, judged: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
        """``judged(rows, filters of their shard)``, for as many shards at once as fit; ``words`` is the size of one."""
        group = max(1, self.bytes // (8 * words))
        done = None
        for low in range(0, self.shards, group):
            some = filters.where(F.col("shard").between(low, low + group - 1))
            value = some.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", column))), lambda x: x[column]).alias("f")).scalar()
            if group >= self.shards:
                return judged(rows, F.get(value, shard))
            part = written(judged(rows.where(shard.between(low, low + group - 1)), F.get(value, shard - low)), "bloom-group")
            done = part if done is None else done.unionByName(part)
        return done

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(self.shards)).cast("int")

    def _bits(self, key: Column, level: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(HASHES * level + i), key), F.lit(64 * self.words[level])) for i in range(HASHES)]

    def _passes(self, key: Column, words: Column, level: int) -> Column:
        hit = F.lit(True)
        for bit in self._bits(key, level):
            word = F.get(words, (bit / 64).cast("int"))
            hit = hit & (F.call_function("getbit", word, (bit % 64).cast("int")) == 1)
        return hit

    def _judge(self, key: Column, filters: Column) -> Column:
        verdict = F.lit(self.depth % 2 == 1)
        for level in reversed(range(self.depth)):
            verdict = F.when(~self._passes(key, F.get(filters, F.lit(level)), level), F.lit(level % 2 == 1)).otherwise(verdict)
        return verdict

    def listed(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """Adds the boolean column ``name``: whether the key is listed."""
        if not self.depth:
            return rows.withColumn(name, F.lit(False))
        return self._by_group(rows, self._shard(key), self.filters, "filters", sum(self.words), lambda some, filters: some.withColumn(name, self._judge(key, filters)))


def page_keys(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, key): the key is host and path, or empty."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return own.withColumn("key", F.concat("host", "path"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page.  Listed is the url (host and path) of each page that ``labels`` calls toxic."""
    pages = page_keys(table(spark, sf_dir, "pages"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    flagged = pages.join(toxic.withColumn("flag", F.lit(True)), "page_id", "left")
    universe = written(flagged.groupBy("key").agg(F.coalesce(F.max("flag"), F.lit(False)).alias("listed")), "url-keys")
    rule, says = rule_for(F.col("host"), F.col("path"), RULES)
    judged = Cascade(universe).listed(pages, F.col("key"), "listed")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def _sql_rules(column: int) -> str:
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[column]}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"CASE {cases} END"


QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {
    "op6_url_filter": rf"""
WITH parsed AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), listed AS (
    SELECT DISTINCT host || path AS key FROM parsed JOIN labels ON page_id = doc_id WHERE toxic = 1
)
SELECT page_id, host, path, {_sql_rules(0)} AS rule,
    coalesce({_sql_rules(1)}, CASE WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed
"""
}
