"""Benchmark decontamination by spaced-seed hashing (operator 1).

Texts become lower-case words without punctuation.  Each mask lays a short
window over the words and hashes only the positions it cares about, so a
substituted word at an ignored position does not break the seed.  Seeds are
taken at every position of items and documents, with masks of which one fits
every way in which a window can agree in MIN_AGREEMENT of its places; equal
hashes put a document position on a diagonal of an item.  Along each diagonal
the item's words are compared with the document's; the overlap counts if some
WINDOW consecutive words (all words of a shorter item) agree in at least
MIN_AGREEMENT of their places.

Only (document, item, diagonal) leaves the seed join, made distinct before it
moves; the words are fetched again for the documents that have one.  Seeds are
broadcast, SLICE_SEEDS at a time: a larger benchmark takes several passes over
the documents, one a slice, so no document seed is ever shuffled and no seed
can be hot.  Only DataFrame functions are used.

Defined results: null, empty and blank texts have no word and overlap nothing;
items of few words match like others, with masks of their own; equal items are
all reported; rows that share a doc_id are one document; rows without a doc_id
are one document a text; other columns are ignored by the report and kept by
``drop_leaks``; an empty benchmark or document table gives clean or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import BROADCAST_ROWS, few, table, written

#: By the words of a window the masks of its items' seeds; 1: the word counts, 0: it is ignored.
FAMILIES = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("111", "1101", "1011"),
    5: ("111", "1101"),
    6: ("1111", "11011"),
    7: ("11011",),
    8: ("11011", "1111", "1100011"),
    9: ("11101", "100111"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("111011", "110100011", "11001011", "110111"),
}
WINDOW, MIN_AGREEMENT = 12, 0.75
#: Seeds that are broadcast at once, about 64 bytes each.
SLICE_SEEDS = 1_000_000
#: By the words of a window the run of equal words that every overlap holds (the SQL joins on it).
RUN = {w: -(-w * 3 // 4) for w in (1, 2, 3)} | {4: 2, 5: 2, 6: 3, 7: 3, 8: 2, 9: 3, 10: 3, 11: 3, 12: 3}


def coded_words(text: Column) -> Column:
    """The words of a text as 64-bit hashes, in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _seeds(frame: DataFrame, codes: str, masks: dict[str, Column]) -> DataFrame:
    """Adds (pos, seed) to ``frame``, a row for every place where a mask fits whose condition holds."""
    n, pos = F.size(codes), F.col("pos")
    seeds = [F.when((pos <= n - len(m)) & own, F.xxhash64(F.lit(m), *[F.get(codes, pos + i) for i, c in enumerate(m) if c == "1"])) for m, own in masks.items()]
    at = frame.withColumn("pos", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return at.withColumn("seed", F.explode(F.array(*seeds))).where("seed IS NOT NULL")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): the hash tells rows of one document apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def _diagonals(docs: DataFrame, items: DataFrame, slice_seeds: int) -> DataFrame:
    """(doc_id, text_hash, item, diagonal), distinct: where the seeds of documents and ``items`` (item, words) meet."""
    width = F.least(F.size("words"), F.lit(WINDOW))
    widths = [r[0] for r in items.select(width).distinct().collect()]
    masks = {m: width.isin([w for w in widths if m in FAMILIES[w]]) for m in sorted({m for w in widths for m in FAMILIES[w]})}
    if not masks:
        return docs.select("doc_id", "text_hash", F.lit(0).alias("item"), F.lit(0).alias("diagonal")).limit(0)
    seeds = _seeds(items, "words", masks).select("seed", "item", F.col("pos").alias("item_pos"))
    slices = -(-seeds.count() // slice_seeds)
    coded = docs.select("doc_id", "text_hash", coded_words(F.col("text")).alias("codes"))
    at = _seeds(coded, "codes", dict.fromkeys(masks, F.lit(True))).select("doc_id", "text_hash", "seed", "pos")
    found = None
    for part in range(slices):
        own = seeds.where(F.pmod(F.xxhash64("item", "item_pos", "seed"), F.lit(slices)) == part)
        hits = at.join(F.broadcast(own), "seed").select("doc_id", "text_hash", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
        hits = written(hits, "seed-hits")
        found = hits if found is None else found.unionByName(hits)
    return found if slices == 1 else found.distinct()


def _agreement(part: Column, item: Column, shift: Column) -> Column:
    """Per word of the item 1 if ``part`` of the document, ``shift`` words later, holds it, else 0."""
    at = lambda i: F.when(i >= shift, i - shift)
    return F.transform(item, lambda w, i: F.coalesce((F.get(part, at(i)) == w).cast("int"), F.lit(0)))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _counts(same: Column) -> Column:
    """Whether some window of the 0/1 array agrees well enough."""
    width = F.least(F.size(same), F.lit(WINDOW))
    return F.exists(F.sequence(F.lit(1), F.size(same) - width + 1), lambda at: _total(F.slice(same, at, width)) >= F.ceil(MIN_AGREEMENT * width))


def overlaps(docs: DataFrame, benchmark: DataFrame, slice_seeds: int = SLICE_SEEDS) -> DataFrame:
    """(doc_id, text_hash, item_id, matched): verified overlaps, the most agreeing words of any diagonal."""
    every = benchmark.select(F.col("item_id").cast("long"), coded_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    every = written(every.select("item_id", F.xxhash64("words").alias("item"), "words"), "benchmark-items")
    items = every.groupBy("item").agg(F.first("words").alias("words"))
    own = _keyed(docs)
    diagonals = _diagonals(own, items, slice_seeds)
    small = max(diagonals.count(), every.count()) <= BROADCAST_ROWS
    side = F.broadcast if small else lambda rows: rows
    hit = side(diagonals.select("doc_id", "text_hash").distinct())
    texts = own.join(hit, _same(own, hit), "left_semi").select("doc_id", "text_hash", coded_words(F.col("text")).alias("codes"))
    met = side(diagonals.join(side(items), "item"))
    # explode() keeps an expression from being evaluated anew for each use: first it cuts out the
    # words beside the diagonal, so that the document stays behind, then it compares them
    part = F.explode(F.array(F.slice("codes", F.greatest("diagonal", F.lit(0)) + 1, F.size("words"))))
    met = texts.join(met, _same(texts, met)).select(texts["doc_id"], texts["text_hash"], "item", "words", F.greatest(-F.col("diagonal"), F.lit(0)).alias("shift"), part.alias("part"))
    met = met.select("doc_id", "text_hash", "item", F.explode(F.array(_agreement(F.col("part"), F.col("words"), F.col("shift")))).alias("same"))
    agreed = met.where(_counts(F.col("same"))).groupBy("doc_id", "text_hash", "item").agg(F.max(_total(F.col("same"))).cast("long").alias("matched"))
    return agreed.join(side(every.select("item", "item_id")), "item").select("doc_id", "text_hash", "item_id", "matched")


def _document(frame: DataFrame) -> Column:
    """What tells documents apart: the doc_id, or the text of rows without one."""
    return F.struct(frame["doc_id"], F.when(frame["doc_id"].isNull(), frame["text_hash"]).alias("own"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: contaminated, n_items, items (ids, comma-joined), matched (most words)."""
    found = overlaps(docs, benchmark)
    found = found.groupBy(_document(found).alias("document"), "item_id").agg(F.max("matched").alias("matched")).groupBy("document").agg(
        F.count("*").alias("n_items"),
        F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda i: i.cast("string")), ",").alias("items"),
        F.max("matched").alias("matched"),
    )
    own = _keyed(docs)
    every = own.select(_document(own).alias("document")).distinct()
    return every.join(few(written(found, "leaks")), "document", "left").select(
        "document.doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item."""
    found = overlaps(docs, benchmark)
    gone = few(written(found.select(_document(found).alias("__hopweave_gone")).distinct(), "leaks"))
    mine = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("own"))
    return docs.join(gone, mine == F.col("__hopweave_gone"), "left_anti").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports the overlaps of every document of ``documents`` with ``benchmark``."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_RUN = f"CASE {' '.join(f'WHEN least(len(w), {WINDOW}) = {w} THEN {r}' for w, r in RUN.items())} END"
QUERIES = {"op1_decontamination": op1_decontamination}
#: Knows no masks: whatever agrees in enough places holds a run of equal words, and all diagonals of those are compared.
SQL = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, {_RUN} AS run FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
druns AS (
    SELECT doc_id, run, pos, hash(w[pos : pos + run - 1]) AS seq
    FROM (SELECT doc_id, w, run, unnest(range(1, len(w) - run + 2)) AS pos FROM d, (SELECT DISTINCT run FROM b) WHERE len(w) >= run)
),
bruns AS (
    SELECT item_id, run, pos, hash(w[pos : pos + run - 1]) AS seq FROM (SELECT item_id, w, run, unnest(range(1, len(w) - run + 2)) AS pos FROM b)
),
hits AS (
    SELECT DISTINCT doc_id, item_id, druns.pos - bruns.pos AS diagonal FROM druns JOIN bruns ON druns.run = bruns.run AND druns.seq = bruns.seq
),
aligned AS (
    SELECT h.doc_id, h.item_id, list_transform(range(0, len(b.w)), lambda i: CASE WHEN diagonal + i >= 0 AND d.w[diagonal + i + 1] = b.w[i + 1] THEN 1 ELSE 0 END) AS same
    FROM hits h JOIN d ON h.doc_id = d.doc_id JOIN b ON h.item_id = b.item_id
),
found AS (
    SELECT doc_id, item_id, max(list_sum(same)) AS matched FROM aligned
    WHERE len(list_filter(range(1, len(same) - least(len(same), {WINDOW}) + 2), lambda k: list_sum(same[k : k + least(len(same), {WINDOW}) - 1]) >= ceil({MIN_AGREEMENT} * least(len(same), {WINDOW})))) > 0
    GROUP BY doc_id, item_id
),
own AS (
    SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(matched) AS matched FROM found GROUP BY doc_id
)
SELECT e.doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, CAST(coalesce(matched, 0) AS BIGINT) AS matched
FROM (SELECT DISTINCT doc_id FROM documents) e LEFT JOIN own ON e.doc_id = own.doc_id
"""
}
