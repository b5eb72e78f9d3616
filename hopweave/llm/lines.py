"""Line dedup by site-relative frequency (operator 7).

Lines are grouped by host.  A line that more than ``ratio`` of the host's pages
contain, and at least ``min_pages`` of them, is boilerplate of that host and is
dropped from all its pages.  A page counts once for a line however often it
holds it.  Per host there are at most (mean distinct lines a page) / ratio such
lines, so they travel to the pages as one array a host: broadcast while the
counted lines of all hosts are few, else joined by host.

Lines are compared without surrounding blanks; they are counted under 64-bit
hashes, so that no line travels.  Blank lines are never dropped.

Defined results: a null text stays null and has no line; the empty text has
one, blank, line; a null host is a host of its own name, the empty one; rows
that repeat are pages of their own; other columns are kept, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import table, written

RATIO, MIN_PAGES = 0.05, 3
#: Boilerplate lines (8 bytes each) of all hosts up to which they are broadcast.
BROADCAST_LINES = 200_000
BLANKS = " \t\r"


def _keys(text: Column) -> Column:
    """Per line its hash, null for a blank line."""
    return F.transform(F.split(text, "\n"), lambda line: F.when(F.btrim(line, F.lit(BLANKS)) != "", F.xxhash64(F.btrim(line, F.lit(BLANKS)))))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): per host the hashes of its boilerplate lines."""
    own = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    lines = own.where(F.col("text").isNotNull()).select("host", F.explode(F.array_distinct(F.array_compact(_keys(F.col("text"))))).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("holding")).where(F.col("holding") >= min_pages)
    frequent = counted.join(totals, "host").where(F.col("holding") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """The pages with ``text`` rid of boilerplate lines; optional columns count the lines."""
    found = written(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    few = (found.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES
    found = found.select(F.col("host").alias("__hopweave_host"), F.col("lines").alias("__hopweave_lines"))
    own = pages.withColumn("__hopweave_key", F.coalesce(F.col(host), F.lit("")))
    own = own.join(F.broadcast(found) if few else found, F.col("__hopweave_key") == F.col("__hopweave_host"), "left")
    own = own.withColumn("__hopweave_hits", F.array_intersect(_keys(F.col(text)), F.col("__hopweave_lines")))
    whole = F.split(F.col(text), "\n")
    key = lambda line: F.xxhash64(F.btrim(line, F.lit(BLANKS)))
    some = F.size("__hopweave_hits") > 0
    own = own.withColumn("__hopweave_kept", F.when(some, F.filter(whole, lambda line: (F.btrim(line, F.lit(BLANKS)) == "") | ~F.array_contains(F.col("__hopweave_hits"), key(line)))))
    out = {}
    if n_lines:
        out[n_lines] = F.when(F.col(text).isNull(), 0).otherwise(F.size(whole)).cast("long")
    if n_removed:
        out[n_removed] = F.when(some, F.size(whole) - F.size("__hopweave_kept")).otherwise(0).cast("long")
    own = own.withColumns(out) if out else own
    own = own.withColumn(text, F.when(some, F.array_join("__hopweave_kept", "\n")).otherwise(F.col(text)))
    return own.drop("__hopweave_key", "__hopweave_host", "__hopweave_lines", "__hopweave_hits", "__hopweave_kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops boilerplate from every document; its source is the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = drop_boilerplate(docs, "source", "text", n_lines="n_lines", n_removed="n_removed")
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {
    "op7_line_dedup": rf"""
WITH pages AS (
    SELECT row_number() OVER () AS page, doc_id, coalesce(source, '') AS host, text FROM documents
), lines AS (
    SELECT page, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM pages WHERE text IS NOT NULL
), keyed AS (
    SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines
), totals AS (
    SELECT host, count(*) AS pages FROM pages GROUP BY host
), frequent AS (
    SELECT k.host, k.bare FROM keyed k JOIN totals t ON k.host = t.host WHERE bare <> ''
    GROUP BY k.host, k.bare, t.pages
    HAVING count(DISTINCT page) >= {MIN_PAGES} AND count(DISTINCT page) > {RATIO} * t.pages
), marked AS (
    SELECT k.*, f.bare IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.host = f.host AND k.bare = f.bare
), kept AS (
    SELECT page, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
    FROM marked GROUP BY page
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM pages p LEFT JOIN kept k ON p.page = k.page
"""
}
