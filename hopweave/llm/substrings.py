"""Substring dedup by super-k-mer partitioning (operator 10).

A window is WINDOW consecutive words.  Its minimiser is the smallest hash of
its GRAM-word grams, so equal windows have equal minimisers.  Consecutive
windows that share a minimiser are cut as one packed string, the super-k-mer,
which travels to the minimiser's bucket; there the windows of all strings are
sorted, and each learns the smallest document in which it starts.

1. Every document's minimisers are counted.  Those of more than one document
   go into a bitmap of fixed size (BITMAP_BITS), frequent ones into another.
2. Super-k-mers whose minimiser is in the first bitmap are cut; others cannot
   be shared.  A false hit costs a string's travel, never a wrong result.  Those
   of a frequent minimiser are cut again by a second minimiser, so a phrase
   that occurs everywhere does not gather all strings in one bucket.
3. A task sends each distinct string once, with the smallest of its documents;
   occurrences keep only the string's 128-bit digest.  A string has at most
   LONGEST windows, so text that repeats itself does not make it long.
4. Buckets sort the 128-bit digests of their windows and give each string runs
   of windows with their first document.  A bucket of over LARGE strings, as
   near copies by the million make it, is no task's: Spark sorts its windows.
   The runs join the occurrences, and covered words leave the documents.

Defined results: null, empty and blank texts have no word; texts shorter than
a window keep all; windows repeated within one document, or in rows that share
a doc_id, are kept; a null doc_id counts as larger than any other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import few, in_batches, table, written

WINDOW, GRAM = 50, 8
#: 16 MB each: minimisers of several documents, and frequent ones.
BITMAP_BITS = 1 << 27
#: Super-k-mers from which on a minimiser's bucket is divided.
FREQUENT = 2_000
#: Packed strings that a task keeps to send each but once, in bytes.
PENDING_BYTES = 32 << 20
#: Windows of a string; strings up to which one task sorts the windows of a bucket.
LONGEST, LARGE = 256, 2_000
_LAST = (1 << 63) - 1
_ORDERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def minimisers(words: list[bytes], order: int = 0) -> np.ndarray:
    """The minimiser of each window of a text of at least WINDOW words."""
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = grams * np.uint64(0x100000001B3) + each[i : i + len(grams)]
    least, width, span = _mixed(grams * _ORDERS[order]), 1, WINDOW - GRAM + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of maximal runs of equal values."""
    borders = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *borders.tolist()], [*borders.tolist(), len(values)], strict=True))


def _in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.view(np.int64) % BITMAP_BITS
    return bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & np.uint8(1) > 0


def repeated_minimisers(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The two bitmaps, from all documents (id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if len(words) >= WINDOW:
                    least = minimisers(words)
                    own = least[np.flatnonzero(np.append(True, least[1:] != least[:-1]))]
                    found.append(own)
                    ids.append(np.full(len(own), doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], ["minimiser", "id"])

    every = docs.select("id", "text").mapInArrow(in_batches(cut, 512), "minimiser long, id long")
    counted = every.groupBy("minimiser").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high")
    bit = F.pmod("minimiser", F.lit(BITMAP_BITS)) + 1
    marks = counted.select(bit.alias("bit"), F.explode(F.when(F.col("n") > FREQUENT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("kind"))
    parts = marks.groupBy("kind", F.call_function("bitmap_bucket_number", "bit").alias("part")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "bit")).alias("bits"))
    maps = np.zeros((2, BITMAP_BITS // 8), np.uint8)
    for kind, part, bits in zip(*(column.to_pylist() for column in parts.toArrow().select(["kind", "part", "bits"]).columns), strict=True):
        own = np.frombuffer(bits, np.uint8)
        maps[kind, (part - 1) * 4096 : (part - 1) * 4096 + len(own)] = own
    return maps[0], maps[1]


_CUT = "id long, hash long, start int, d1 long, d2 long, bucket long, low long, packed binary"


def super_kmers(docs: DataFrame, shared: np.ndarray, frequent: np.ndarray) -> DataFrame:
    """Occurrences (packed is null) and distinct packed strings (packed is set) of documents (id, hash, text)."""
    maps = docs.sparkSession.sparkContext.broadcast((shared.tobytes(), frequent.tobytes()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, many = (np.frombuffer(m, np.uint8) for m in maps.value)
        pending: dict[bytes, list] = {}
        size = 0

        def strings() -> pa.RecordBatch:
            n = len(pending)
            pairs = np.frombuffer(b"".join(pending), np.int64).reshape(-1, 2)
            nothing = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays(
                [nothing, nothing, pa.nulls(n, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.array([p[i] for p in pending.values()], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))],
                ["id", "hash", "start", "d1", "d2", "bucket", "low", "packed"],
            )

        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            digests: list[bytes] = []
            for doc, own_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if len(words) < WINDOW:
                    continue
                least = minimisers(words)
                hits = _in(several, least)
                if not hits.any():
                    continue
                bucket = least.view(np.int64)
                if (often := hits & _in(many, least)).any():
                    bucket = np.where(often, _mixed(least ^ minimisers(words, 1) * np.uint64(3)).view(np.int64), bucket)
                for a, b in ((c, min(c + LONGEST, end)) for begin, end in runs(bucket) if hits[begin] for c in range(begin, end, LONGEST)):
                    packed = b" ".join(words[a : b - 1 + WINDOW])
                    digest = xxhash.xxh3_128_digest(packed)
                    rows.append((doc, own_hash, a))
                    digests.append(digest)
                    known = pending.get(digest)
                    if known is None:
                        pending[digest] = [int(bucket[a]), doc, packed]
                        size += len(packed)
                    elif doc < known[1]:
                        known[1] = doc
            if rows:
                pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                    ["id", "hash", "start", "d1", "d2", "bucket", "low", "packed"],
                )
            if size > PENDING_BYTES:
                yield strings()
                pending, size = {}, 0
        if pending:
            yield strings()

    return docs.select("id", "hash", "text").mapInArrow(in_batches(cut, 512), _CUT)


def _window_digests(packed: bytes) -> np.ndarray:
    """Two 64-bit halves of the digest of each window of a packed string."""
    ends = np.flatnonzero(np.frombuffer(packed + b" ", np.uint8) == 32)
    begins = np.append(0, ends[:-1] + 1)
    pairs = zip(begins[: len(ends) - WINDOW + 1].tolist(), ends[WINDOW - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(packed[a:b]) for a, b in pairs]), np.int64).reshape(-1, 2)


def _first_documents(strings: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per string (d1, d2, low, packed) of one bucket its runs of windows (from, to, first document)."""
    if len(strings) == 1:
        return [[(0, strings[0][3].count(b" ") + 2 - WINDOW, strings[0][2])]]
    windows = [_window_digests(packed) for _, _, _, packed in strings]
    counts = [len(w) for w in windows]
    every, lows = np.concatenate(windows), np.repeat(np.array([s[2] for s in strings], np.int64), counts)
    order = np.lexsort((lows, every[:, 1], every[:, 0]))
    ranked = every[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1))
    first = np.empty(len(lows), np.int64)
    first[order] = lows[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return [[(a, b, int(own[a])) for a, b in runs(own)] for own in np.split(first, np.cumsum(counts)[:-1])]


def large_bucket_runs(strings: DataFrame) -> DataFrame:
    """(d1, d2, run) of the distinct strings (d1, d2, low, packed): runs of one window, sorted by Spark."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d1, d2, low, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _window_digests(packed)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[:, 0]), pa.array(own[:, 1]), *(pa.array(np.full(n, x), pa.int64()) for x in (low, d1, d2)), pa.array(np.arange(n), pa.int32())], ["w1", "w2", "low", "d1", "d2", "at"]
                )

    windows = written(strings.select("d1", "d2", "low", "packed").mapInArrow(unpacked, "w1 long, w2 long, low long, d1 long, d2 long, at int"), "large-buckets")
    first = windows.groupBy("w1", "w2").agg(F.min("low").alias("low"))
    return windows.drop("low").join(first, ["w1", "w2"]).select("d1", "d2", F.struct(F.col("at").alias("begin"), (F.col("at") + 1).alias("end"), "low").alias("run"))


def window_runs(strings: DataFrame) -> DataFrame:
    """(d1, d2, runs) of the distinct strings (bucket, d1, d2, low, packed), bucket by bucket."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("low", pa.int64())]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, done = None, [], []

        def flush() -> pa.RecordBatch:
            d1, d2, found = ([d[i] for d in done] for i in range(3))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(found, kind)], ["d1", "d2", "runs"])

        def close() -> None:
            if own:
                for string, found in zip(own, _first_documents(own), strict=True):
                    done.append((string[0], string[1], [{"begin": a, "end": b, "low": low} for a, b, low in found]))

        for batch in batches:
            for bucket, *string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    close()
                    now, own = bucket, []
                own.append(tuple(string))
            if len(done) > 10_000:
                yield flush()
        close()
        yield flush()

    ordered = strings.select("bucket", "d1", "d2", "low", "packed").sortWithinPartitions("bucket")
    return ordered.mapInArrow(counted, "d1 long, d2 long, runs array<struct<begin:int,end:int,low:long>>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, hash, spans): per document the spans of words that a smaller document's window covers."""
    cut = written(super_kmers(docs, *repeated_minimisers(docs)), "super-kmers")
    strings, occurrences = cut.where(F.col("packed").isNotNull()), cut.where(F.col("packed").isNull()).select("id", "hash", "start", "d1", "d2")
    large = written(strings.groupBy("bucket").count().where(F.col("count") > LARGE).select("bucket"), "large-buckets")
    some = not large.isEmpty()
    one = lambda own: own.groupBy("bucket", "d1", "d2").agg(F.min("low").alias("low"), F.first("packed").alias("packed"))
    small = strings.join(few(large), "bucket", "left_anti") if some else strings
    found = window_runs(one(small.repartition("bucket"))).select("d1", "d2", F.explode("runs").alias("run"))
    if some:
        found = found.unionByName(large_bucket_runs(one(strings.join(few(large), "bucket", "left_semi"))))
    placed = occurrences.join(found, ["d1", "d2"]).where("run.low < id")
    spans = placed.select("id", "hash", F.struct((F.col("start") + F.col("run.begin")).alias("begin"), (F.col("start") + F.col("run.end") - 1 + WINDOW).alias("end")).alias("span"))
    return spans.groupBy("id", "hash").agg(F.collect_set("span").alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def removals(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): its words, those removed, and the digest of those kept."""
    own = keyed(docs)
    joined = own.join(repeated_spans(own), ["id", "hash"], "left").select("doc_id", "text", F.expr("transform(spans, s -> s.begin)").alias("begins"), F.expr("transform(spans, s -> s.end)").alias("ends"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, digests = [], [], []
            for text, begins, ends in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                totals.append(len(words))
                removed = 0
                if begins:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, begins, 1)
                    np.add.at(depth, ends, -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    removed = len(words) - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                gone.append(removed)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(in_batches(kept, 512), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes repeated windows from every document of ``documents``."""
    return removals(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQL = {
    "op10_substring_dedup": rf"""
WITH own AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
    SELECT doc_id, pos, md5(array_to_string(w[pos : pos + {WINDOW - 1}], ' ')) AS seq
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS pos FROM own WHERE len(w) >= {WINDOW})
), firsts AS (
    SELECT seq, min(doc_id) AS low FROM starts GROUP BY seq HAVING min(doc_id) < max(doc_id)
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS place FROM starts JOIN firsts ON starts.seq = firsts.seq WHERE low < doc_id
), words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM own
), kept AS (
    SELECT w.doc_id, count(*) AS n_words, count(c.place) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.place) FILTER (WHERE c.place IS NULL), '') AS text
    FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.place = c.place GROUP BY w.doc_id
)
SELECT own.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM own LEFT JOIN kept ON own.doc_id = kept.doc_id
"""
}
