"""Embedding near-dedup by the epsilon grid order join (operator 2).

Unit vectors whose cosine is at least ``cosine`` are at most epsilon =
sqrt(2 - 2 cosine) apart.  Vectors are rotated onto their leading principal
directions and sorted by label and grid cells of width epsilon along these.
The sorted sequence is cut into blocks with bounding boxes.  Blocks meet by
label and two neighbouring cells if their boxes are near enough.  Of each pair
one block is at home; of the other those vectors visit that lie within epsilon
of the home's box.  A meeting splits its two intervals recursively, skips
provably distant parts and compares the rest by cosine in double precision.

Equal vectors with equal labels are one node with a weight.  A meeting reports
one link count a vector and a spanning star a component, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, vectors without a label and rows without a vec_id link with
nothing; vectors of different lengths never link; copies link with each other;
rows that share a vec_id are one vector, that of the smallest hash among those
that can link, and one row of the result; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import components, few, table, written

COSINE = 0.98
#: Principal directions of the grid, vectors a block, vectors below which intervals are not split.
DIRECTIONS, BLOCK, LEAF = 6, 1024, 128
#: Components from which the directions are fitted; they need no more to be orthonormal.
FITTED = 256
#: Slack for rounding in geometric tests; the cosine alone decides.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, h1, h2): the vectors that can link, with a 128-bit hash of each."""
    own = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return own.select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def principal_directions(nodes: DataFrame, width: int) -> np.ndarray:
    """The leading principal directions of unit vectors (v), padded with zeros to ``width``."""
    fitted = min(width, FITTED)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((fitted, fitted))
        for batch in batches:
            for size in set(batch.column(1).to_pylist()):
                x = _unit(_matrix(batch.filter(pa.compute.equal(batch.column(1), size)).column(0)))[:, :fitted]
                total[: x.shape[1], : x.shape[1]] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(fitted * fitted)), pa.array(total.ravel())], ["at", "value"])

    parts = nodes.select("v", F.size("v").alias("size")).mapInArrow(summed, "at long, value double")
    second = np.zeros(fitted * fitted)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        second[row["at"]] = row["value"]
    _, directions = np.linalg.eigh(second.reshape(fitted, fitted))
    out = np.zeros((width, min(DIRECTIONS, fitted)))
    out[:fitted] = directions[:, ::-1][:, : out.shape[1]]
    return out


def blocks(nodes: DataFrame, directions: np.ndarray, epsilon: float) -> DataFrame:
    """The epsilon grid order of (id, weight, label, v), cut into blocks: key, block, bounding box, ids, weights, vectors."""
    k, kind = directions.shape[1], nodes.schema["v"].dataType.simpleString()
    order = ["label", "size", "cell", "id"]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, k), np.int32)
            sizes = np.array(batch.column(3).to_pylist(), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                cells[rows] = np.floor(_unit(_matrix(batch.column(2).take(pa.array(rows)))) @ directions[: int(size)] / epsilon)
            grid = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, k), pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, grid], ["id", "weight", "v", "size", "label", "cell"])

    placed = nodes.select("id", "weight", "v", F.size("v").alias("size"), "label").mapInArrow(projected, f"id long, weight long, v {kind}, size int, label string, cell array<int>")
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[tuple], now: tuple) -> pa.RecordBatch:
            vectors = np.stack([v for _, _, v in held])
            p = _unit(vectors) @ directions[: now[1]]
            ids, weights = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{now[0]}/{now[1]}"]), pa.array([held[0][0]], pa.int64()), pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, weights, vectors))],
                ["key", "block", "low", "high", "ids", "weights", "vectors"],
            )

        held, now = [], None
        for batch in batches:
            vectors = batch.column(2)
            offsets, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
            for i, (own, weight, size, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                if held and ((label, size) != now or len(held) == BLOCK):
                    yield block(held, now)
                    held = []
                now = (label, size)
                if not held or held[-1][0] != own:  # a row that repeats follows itself
                    held.append((own, weight, flat[offsets[i] : offsets[i + 1]].copy()))
        if held:
            yield block(held, now)

    return ordered.mapInArrow(cut, "key string, block long, low array<double>, high array<double>, ids binary, weights binary, vectors binary")


def meetings(cut: DataFrame, epsilon: float) -> DataFrame:
    """(key, home, low, high, block): blocks that are not provably distant from the box of a ``home`` of smaller number."""
    box = cut.select("key", "block", "low", "high")
    cells = lambda i, more: F.sequence(F.floor((F.col("low")[i] - more) / epsilon), F.floor((F.col("high")[i] + more) / epsilon))

    def celled(more: float) -> DataFrame:
        first = box.withColumn("c0", F.explode(cells(0, more)))
        return first.withColumn("c1", F.explode(F.when(F.size("low") > 1, cells(1, more)).otherwise(F.array(F.lit(0).cast("long")))))

    a = celled(0.0).select("key", "c0", "c1", F.col("block").alias("home"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = celled(epsilon).select("key", "c0", "c1", "block", "low", "high")
    gaps = F.zip_with(F.zip_with("a_low", "high", lambda x, y: x - y), F.zip_with("low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)) * F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    near = a.join(b, ["key", "c0", "c1"]).where(F.col("home") < F.col("block")).where(apart <= epsilon * epsilon + SLACK)
    return near.groupBy("key", "home", "block").agg(F.first("a_low").alias("low"), F.first("a_high").alias("high"))


def _compare(one: np.ndarray, two: np.ndarray, p: np.ndarray, q: np.ndarray, cosine: float, epsilon: float) -> np.ndarray:
    """Which rows of two intervals link: splits them recursively and skips distant parts."""
    linked = np.zeros((len(one), len(two)), bool)

    def visit(a: int, b: int, c: int, d: int) -> None:
        gap = np.maximum(0, np.maximum(p[a:b].min(axis=0) - q[c:d].max(axis=0), q[c:d].min(axis=0) - p[a:b].max(axis=0)))
        if (gap * gap).sum() > epsilon * epsilon + SLACK:
            return
        if max(b - a, d - c) <= LEAF:
            linked[a:b, c:d] = one[a:b] @ two[c:d].T >= cosine
        elif b - a >= d - c:
            half = (a + b) // 2
            visit(a, half, c, d)
            visit(half, b, c, d)
        else:
            half = (c + d) // 2
            visit(a, b, c, half)
            visit(a, b, half, d)

    visit(0, len(one), 0, len(two))
    return linked


def _stars(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of a bipartite link matrix over ids ``a`` and ``b``."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return []
    some = linked[np.ix_(rows, columns)]
    left, right = a[rows].copy(), b[columns].copy()
    while True:
        before = left.sum(dtype=object), right.sum(dtype=object)
        right = np.minimum(right, np.where(some, left[:, None], np.iinfo(np.int64).max).min(axis=0))
        left = np.minimum(left, np.where(some, right[None, :], np.iinfo(np.int64).max).min(axis=1))
        if before == (left.sum(dtype=object), right.sum(dtype=object)):
            break
    pairs = {*zip(a[rows].tolist(), left.tolist(), strict=True), *zip(b[columns].tolist(), right.tolist(), strict=True)}
    return [(x, y) for x, y in pairs if x != y]


def compared(cut: DataFrame, pairs: DataFrame, directions: np.ndarray, kind: str, cosine: float, epsilon: float) -> DataFrame:
    """(a, b, n): link counts (b null) and edges of stars (n null)."""
    dtype = np.float32 if kind == "array<float>" else np.float64
    fields = "home long, visits boolean, ids binary, weights binary, vectors binary"

    def read(ids: bytes, weights: bytes, vectors: bytes) -> tuple[np.ndarray, ...]:
        own = np.frombuffer(ids, np.int64)
        return own, np.frombuffer(weights, np.int64), np.frombuffer(vectors, dtype).reshape(len(own), -1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block to its home, and to every other home those of its vectors that may link there."""
        for batch in batches:
            for row in range(batch.num_rows):
                block, visits, *data = (batch.column(i)[row].as_py() for i in range(5))
                ids, weights, vectors = read(*data)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([False]), *(pa.array([d], pa.binary()) for d in data)], ["home", "visits", "ids", "weights", "vectors"])
                p = _unit(vectors) @ directions[: vectors.shape[1]] if visits else None
                for visit in visits or ():
                    gap = np.maximum(0, np.maximum(np.array(visit["low"]) - p, p - np.array(visit["high"])))
                    near = (gap * gap).sum(axis=1) <= epsilon * epsilon + SLACK
                    if near.any():
                        some = [pa.array([x[near].tobytes()], pa.binary()) for x in (ids, weights, vectors)]
                        yield pa.RecordBatch.from_arrays([pa.array([visit["home"]], pa.int64()), pa.array([True]), *some], ["home", "visits", "ids", "weights", "vectors"])

    visits = pairs.groupBy("key", "block").agg(F.collect_list(F.struct("home", "low", "high")).alias("visits"))
    rows = cut.join(few(visits, 20_000), ["key", "block"], "left").select("block", "visits", "ids", "weights", "vectors").mapInArrow(sent, fields)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = home = None
        for batch in batches:
            for row in range(batch.num_rows):
                number, visiting, *data = (batch.column(i)[row].as_py() for i in range(5))
                ids, weights, vectors = read(*data)
                x = _unit(vectors)
                p = x @ directions[: x.shape[1]]
                if not visiting:
                    now, home = number, (ids, weights, x, p)
                if now != number:
                    raise ValueError(f"no block {number} is at home")
                linked = _compare(home[2], x, home[3], p, cosine, epsilon)
                if not visiting:
                    np.fill_diagonal(linked, False)
                counts = list(zip(home[0].tolist(), (linked @ weights).tolist(), strict=True))
                if visiting:
                    counts += zip(ids.tolist(), (home[1] @ linked).tolist(), strict=True)
                found = [(i, None, n) for i, n in counts if n] + [(i, j, None) for i, j in _stars(linked, home[0], ids)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], ["a", "b", "n"])

    return rows.repartition("home").sortWithinPartitions("home", "visits").mapInArrow(met, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id of ``vectors`` (vec_id, embedding, label)."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    own = valid(vectors)
    # only hashes decide which vectors are one; the vectors themselves move when the grid is sorted
    members = own.groupBy("vec_id").agg(F.min(F.struct("h1", "h2", "label")).alias("m")).select("vec_id", "m.*")
    members = written(members, "ego-members")
    nodes = written(members.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "ego-nodes")
    every = vectors.select(F.col("vec_id").cast("long")).distinct()
    known = few(nodes)
    chosen = own.join(known, (own.vec_id == known.id) & (own.label == known.label) & (own.h1 == known.h1) & (own.h2 == known.h2)).select("id", "weight", own.label, "v")
    width = chosen.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    directions, kind = principal_directions(chosen, width), chosen.schema["v"].dataType.simpleString()
    cut = written(blocks(chosen, directions, epsilon), "ego-blocks")
    found = written(compared(cut, meetings(cut, epsilon), directions, kind, cosine, epsilon), "ego-links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"), "ego-components")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    linked = nodes.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left").where("others IS NOT NULL OR weight > 1")
    linked = linked.select("label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "id").alias("component"))
    placed = members.join(few(written(linked, "ego-linked")), ["label", "h1", "h2"]).select("vec_id", "links", "component")
    component = F.coalesce("component", "vec_id")
    return every.join(placed, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
SQL = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), v AS (
    SELECT vec_id, any_value(label) AS label, any_value(e) AS e FROM usable GROUP BY vec_id
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
    SELECT a, min(b) AS low FROM reach GROUP BY a
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, coalesce(vec_id <= coalesce(low, vec_id), true) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
}
