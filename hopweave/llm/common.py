"""What several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task's union-find may hold: nodes before the last task, all that is left in it.
FOREST_EDGES = 1_000_000


#: Rows up to which a side of a join is broadcast; they are ids and numbers, under 100 bytes each.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one in fewer files than there are cores is dealt out to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, to be broadcast if there are at most ``most``; otherwise the join shuffles them."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a single machine, where it may be unset, one under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/hopweave-checkpoints"


#: Tables to delete when the driver ends: later queries may read them until then.
_WRITTEN: list[str] = []


@atexit.register
def _delete_written() -> None:
    context = SparkContext._active_spark_context
    if context is None or context._jvm is None:
        return
    with contextlib.suppress(Exception):  # the JVM may be gone already
        for name in _WRITTEN:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers outlive their tasks."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


class Forest:
    """Union-find over 64-bit ids whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (parent := up.get(top, top)) != top:
            top = parent
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        self.up.setdefault(low, low)

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


def _forests(batches: Iterator[pa.RecordBatch], most: float = FOREST_EDGES) -> Iterator[pa.RecordBatch]:
    """Replaces edges by stars with the same components, ``most`` nodes at a time; parts are not merged."""

    def stars(forest: Forest) -> pa.RecordBatch:
        nodes, roots = forest.stars()
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > most:
            yield stars(forest)
            forest = Forest()
    yield stars(forest)


def components(edges: DataFrame, name: str = "components", forest_edges: int = FOREST_EDGES, forest_nodes: int = FOREST_EDGES) -> DataFrame:
    """Connected components: (node, root) for every node of ``edges`` (a, b) but the roots.

    Each task first replaces its edges by stars.  What is left is finished by
    one task if it is few; otherwise large-star and small-star rounds run,
    each written to the shared folder, until the edges are stars already.
    The root of a component is its smallest node.
    """
    stars = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(lambda batches: _forests(batches, forest_nodes), "a long, b long"), name)
    rounds = 0
    while (left := stars.count()) > forest_edges:
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        after = written(small, name)
        rounds += 1
        same = after.count() == left and after.join(stars, ["a", "b"], "left_anti").isEmpty()
        remove(stars)
        stars = after
        if same:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if left:
        final = written(stars.coalesce(1).mapInArrow(lambda batches: _forests(batches, float("inf")), "a long, b long"), name)
        remove(stars)
        stars = final
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def in_batches(function: Callable, rows: int) -> Callable:
    """An Arrow function that sees at most ``rows`` rows at once."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return sliced
