"""SimHash near-dedup (operator 4): fingerprints, and links by anchor-point covering.

The anchors are the codewords of a covering code: the first 46 bits of a
fingerprint are two blocks of 23, each covered by the perfect binary Golay code
(radius 3).  A fingerprint has one home anchor, the pair of codewords within
radius 3 of its blocks.  It is replicated to every anchor within the covering
radius plus the threshold, the threshold being shared by the blocks.  If two
fingerprints differ in at most ``threshold`` bits, one is a replica at the
other's home, so comparing homes with replicas per anchor loses no link.
Equal fingerprints are one node, so copies, however many, are never paired.

Defined results: null, empty and blank texts have no word and the fingerprint
zero, which links like any other; a text of fewer words than a shingle is one
shingle; a bit set in exactly half the shingles is 0; rows that repeat are
nodes of their own with equal results; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.llm.common import components, in_batches, table, written

#: Generator polynomial of the binary Golay code of length 23, and its covering radius.
GOLAY_POLYNOMIAL = 0b110001110101
GOLAY_LENGTH, GOLAY_RADIUS = 23, 3
#: The seed of the shingles' XXH64.
SEED = 42
SHINGLE_WORDS, THRESHOLD = 3, 2


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, A-Z lower-cased, repeats included."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = np.zeros(len(own) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1, out=starts[1:])
    begins, ends = starts[: len(own) - words + 1].tolist(), (starts[words:] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit by bit the strict majority of the hashes, as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_of(shingle_hashes(t, shingle_words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(in_batches(fingerprinted, 512), "doc_id long, fp long")


class GolayCover:
    """The Golay code as a covering code of 23-bit words."""

    def __init__(self, threshold: int):
        bits = 1 << np.arange(GOLAY_LENGTH, dtype=np.int64)
        light = np.array([sum(some) for weight in range(GOLAY_RADIUS + 1) for some in combinations(bits.tolist(), weight)], np.int64)
        self.leaders = np.zeros(1 << 11, np.int64)
        self.leaders[self.syndrome(light)] = light
        codewords = np.zeros(1, np.int64)
        for shift in range(GOLAY_LENGTH - 11):
            codewords = np.concatenate([codewords, codewords ^ GOLAY_POLYNOMIAL << shift])
        #: by excess over the radius: where each syndrome's steps to anchors begin, and the steps
        self.steps = []
        distance = np.bitwise_count(self.leaders.astype(np.int32)[:, None] ^ codewords.astype(np.int32)[None, :])
        for excess in range(threshold + 1):
            near = distance <= GOLAY_RADIUS if excess == 0 else distance == GOLAY_RADIUS + excess
            rows, columns = np.nonzero(near)
            starts = np.searchsorted(rows, np.arange((1 << 11) + 1))
            self.steps.append((starts, codewords[columns]))

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(GOLAY_LENGTH - 1, 10, -1):
            rest ^= np.where(rest >> bit & 1, GOLAY_POLYNOMIAL << (bit - 11), 0)
        return rest


@lru_cache(maxsize=4)
def _cover(threshold: int) -> GolayCover:
    return GolayCover(threshold)


def _blocks(fp: np.ndarray, cover: GolayCover) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block the syndromes and the home codewords."""
    bits, out = fp.view(np.uint64), []
    for block in range(2):
        word = (bits >> np.uint64(GOLAY_LENGTH * block) & np.uint64((1 << GOLAY_LENGTH) - 1)).astype(np.int64)
        syndrome = cover.syndrome(word)
        out.append((syndrome, word ^ cover.leaders[syndrome]))
    return out


def home_anchors(fp: np.ndarray) -> np.ndarray:
    (_, one), (_, two) = _blocks(fp, _cover(0))
    return one << GOLAY_LENGTH | two


def replicas(fp: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in fp, anchors), for all anchors within radius plus threshold."""
    cover = _cover(threshold)
    (s1, c1), (s2, c2) = _blocks(fp, cover)
    for first in range(threshold + 1):
        for second in range(threshold + 1 - first):
            starts1, steps1 = cover.steps[first]
            starts2, steps2 = cover.steps[second]
            n1, n2 = starts1[s1 + 1] - starts1[s1], starts2[s2 + 1] - starts2[s2]
            number = n1 * n2
            which = np.repeat(np.arange(len(fp)), number)
            within = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            one = c1[which] ^ steps1[starts1[s1[which]] + within // n2[which]]
            two = c2[which] ^ steps2[starts2[s2[which]] + within % n2[which]]
            yield which, one << GOLAY_LENGTH | two


def fingerprint_links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): different fingerprints of ``nodes`` (fp) within ``threshold`` bits, each pair once."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fp)), batch.column(0)], ["anchor", "a"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for which, anchor in replicas(fp, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[which])], ["anchor", "b"])

    fps = nodes.select("fp")
    home = fps.mapInArrow(in_batches(homes, 8192), "anchor long, a long")
    copy = fps.mapInArrow(in_batches(copies, 8192), "anchor long, b long")
    # Spark takes the replicas, some 60 a fingerprint, for as many rows as there are fingerprints: it must never broadcast them
    return home.hint("merge").join(copy.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def fingerprint_components(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Adds component_id to (doc_id, fp): the smallest doc_id reachable over links."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(fingerprint_links(nodes, threshold), "simhash-components")
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: Near-duplicate documents: shingle words, least Jaccard similarity of shingle sets.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Bands and rows of the sketch that proposes pairs beyond the anchors' reach.
BANDS, ROWS = 20, 5
#: Pairs left up to which no further pivot is tried.
PAIRS_AT_ONCE = 200_000
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, from the smallest of the permuted hashes of each of its rows."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        np.minimum(least, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = (keys ^ least[row::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, fp, keys): digest of the words, shingles, fingerprint, band keys."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, fps, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, NEAR_WORDS)
                digests.append(xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())))
                sizes.append(len(np.unique(hashes)))
                fps.append(fingerprint_of(hashes))
                keys.append(band_keys(hashes).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "h1", "h2", "n", "fp", "keys"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(in_batches(sketched, 512), "doc_id long, h1 long, h2 long, n long, fp long, keys array<long>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, NEAR_WORDS)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(in_batches(listed, 512), "doc_id long, shingles array<long>")


def _sorted_join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the input: by Spark's guess of their size either could be broadcast."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _sized(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of pairs (one, two): each once, without those whose sizes rule the similarity out."""
    pairs = pairs.where("one.id != two.id").where(F.least("one.n", "two.n") >= similarity * F.greatest("one.n", "two.n"))
    return pairs.select(F.greatest("one.id", "two.id").alias("a"), F.least("one.id", "two.id").alias("b")).distinct()


def _pivot_pairs(apart: DataFrame) -> DataFrame:
    """(one, two): every member of a key with the member that meets most others of other components."""
    own = apart.groupBy("me.id").agg(F.sum("others").alias("met"))
    rank = F.struct("met", -F.col("id"))
    ranked = _sorted_join(apart.withColumn("id", F.col("me.id")), own, "id").select("key", "root", "me", rank.alias("rank"))
    pivots = ranked.groupBy("key").agg(F.max_by(F.struct("me", "root"), "rank").alias("pivot"))
    return _sorted_join(apart, pivots, "key").where("root != pivot.root").select(F.col("me").alias("one"), F.col("pivot.me").alias("two"))


def _all_pairs(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(one, two): all pairs of two components that share a key and may be similar.

    Sets ordered by one order, rare shingles first, share one of their first
    n - ceil(similarity n) + 1 if they are similar, and behind the first that
    they share there is room for the rest: pairs without that are none.
    """
    own = apart.groupBy("me", "root").agg(F.collect_set("key").alias("keys")).withColumn("id", F.col("me.id"))
    shingles = _sorted_join(own.select("id", "root"), sets.withColumnRenamed("doc_id", "id"), "id").select("id", "root", F.size("shingles").alias("of"), F.explode("shingles").alias("shingle"))
    held = Window.partitionBy("shingle")
    shingles = shingles.withColumns({"often": F.count("*").over(held), "several": F.min("root").over(held) != F.max("root").over(held)})
    ranked = shingles.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("often", "shingle")))
    # a shingle of one component pairs nothing; of others each member meets the other components, never its own,
    # and only those where the member with most room left has enough of it
    first = written(ranked.where(F.col("several") & (F.col("at") <= F.col("of") - F.ceil(similarity * F.col("of") - 1e-9) + 1)).select("id", "root", "shingle", "of", (F.col("of") - F.col("at")).alias("rest")), "near-prefixes")
    one, two = (first.select("shingle", *[F.col(c).alias(c + k) for c in ("id", "root", "of", "rest")]) for k in "12")
    enough = lambda rest, of: (1 + F.least("rest1", rest)) * (1 + similarity) >= similarity * (F.col("of1") + F.col(of)) - 1e-9
    other = first.groupBy("shingle", F.col("root").alias("root2")).agg(F.max("rest").alias("most"), F.min("of").alias("least"))
    facing = _sorted_join(one, other, "shingle").where(F.col("root1") < F.col("root2")).where(enough("most", "least")).drop("most", "least")
    member = lambda k, name: own.select(F.col("id").alias("id" + k), F.col("keys").alias("keys" + k), F.col("me").alias(name))
    pairs = _sorted_join(facing, two, ["shingle", "root2"]).where(enough("rest2", "of2")).select("id1", "id2").distinct()
    return _sorted_join(_sorted_join(pairs, member("1", "one"), "id1"), member("2", "two"), "id2").where(F.arrays_overlap("keys1", "keys2")).select("one", "two")


def near_duplicate_groups(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """(doc_id, group): documents that are not the smallest of their group of near copies.

    Texts with equal words are one class.  Classes meet under a key: a band of
    the sketch, a fingerprint, or two fingerprints that meet at an anchor.  The
    groups are the components of all pairs that meet and whose shingle sets'
    Jaccard similarity is at least ``similarity``.  Pairs inside a component
    need no comparison, so each class is first compared with a key's first and
    the two before it; then, while many pairs are left, with the key's member
    that meets most others; at last all pairs left between two components are.
    """
    own = docs.where(F.col("doc_id").isNotNull())
    sketches = written(_sketches(own), "near-sketches")
    classes = written(sketches.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-classes")
    met = fingerprint_links(written(classes.select("fp").distinct(), "near-fingerprints"))
    me = F.struct("id", "n").alias("me")
    by_anchor = _sorted_join(met.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64("a", "b").alias("key")), classes.select("id", "n", "fp"), "fp").select("key", me)
    by_key = classes.select(F.explode(F.concat("keys", F.array("fp"))).alias("key"), me)
    size = F.count("*").over(Window.partitionBy("key"))
    meetings = written(by_key.unionByName(by_anchor).withColumn("size", size).where("size > 1"), "near-meetings")
    needed = meetings.select(F.col("me.id").alias("doc_id")).distinct()
    texts = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id").dropDuplicates(["doc_id"])
    sets = written(_shingle_sets(texts), "near-shingles")

    def similar(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        shared = F.size(F.array_intersect("sa", "sb"))
        return written(_sorted_join(_sorted_join(pairs, one, "a"), two, "b").where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "near-links")

    order = Window.partitionBy("key").orderBy("me.id")
    before = F.array_distinct(F.array_compact(F.array(F.first("me").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lag("me", 1).over(order), F.lag("me", 2).over(order))))
    compared = written(_sized(meetings.select(F.col("me").alias("one"), before.alias("before")).select("one", F.explode("before").alias("two")), similarity), "near-pairs")
    links = similar(compared)
    roots, found, apart = components(links, "near-components"), True, meetings
    while True:
        # a key whose members are one component stays so: the next round has only the others, each with all its members
        placed = _sorted_join(apart.select("key", "size", "me"), roots, F.col("me.id") == F.col("node"), "left").select("key", "size", "me", F.coalesce("root", "me.id").alias("root"))
        others = F.col("size") - F.count("*").over(Window.partitionBy("key", "root"))
        apart = written(placed.withColumn("others", others).where("others > 0"), "near-apart")
        left = (apart.agg(F.sum("others")).first()[0] or 0) // 2
        if left == 0:
            break
        last = not found or left <= PAIRS_AT_ONCE
        pairs = _sized(_all_pairs(apart, sets, similarity) if last else _pivot_pairs(apart), similarity)
        pairs = written(_sorted_join(pairs, compared, ["a", "b"], "left_anti"), "near-pairs")
        more = similar(pairs)
        found = not more.isEmpty()
        if found:
            links = links.unionByName(more)
            roots = components(links, "near-components")
        if last:
            break
        compared = compared.unionByName(pairs)
    placed = _sorted_join(classes.select("h1", "h2", "id"), roots, F.col("id") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "id").alias("group"))
    return _sorted_join(sketches.select("doc_id", "h1", "h2"), placed, ["h1", "h2"]).where("doc_id != group").select("doc_id", "group").distinct()


def keep_one(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The documents without those that are near copies of a smaller doc_id's; null ids stay."""
    gone = near_duplicate_groups(docs, similarity).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document of ``documents``."""
    fps = written(fingerprints(table(spark, sf_dir, "documents")), "simhash-fingerprints")
    return fingerprint_components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
#: SQL has no seeded XXH64: tests compare with brute force.
SQL: dict[str, str] = {}
