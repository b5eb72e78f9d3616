"""Model, search and page calls as a keyed response table.

``resolve`` looks requests up, sends the distinct misses to a provider, stores
what comes back and joins it to the requests.  Re-runs are deterministic, equal
requests are sent once, and failures are rows with an error.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions.numeric import BACKOFFS
from hopweave.functions.text import squeeze
from hopweave.operators.keyed import misses, upsert

RESPONSES = "key string, request string, response string, error string, created_at timestamp"


def request_key(request: Column, model: str = "") -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"model={model}"), squeeze(F.lower(request))))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to the folder of spark.checkpoint.dir (locally one under the warehouse) and reads them back."""
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    path = f"{folder or spark.conf.get('spark.sql.warehouse.dir') + '/hopweave-responses'}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@dataclass
class Provider:
    """A client: ``connect`` runs once a task and returns request -> response; tries are bounded.

    With ``keys``, a task works with one of them, given to ``connect``.  With
    ``per_minute``, there is one task a key, which spaces its requests; waits
    between tries are those of ``numeric.BACKOFFS``.
    """

    connect: Callable[..., Callable[[str], str]]
    tries: int = 3
    partitions: int = 16
    keys: tuple[str, ...] = ()
    per_minute: float | None = None
    backoff: str | None = None

    def answer(self, requests: DataFrame) -> DataFrame:
        """(key, request, response, error, created_at) of requests (key, request)."""
        connect, tries, keys = self.connect, self.tries, self.keys
        partitions = max(1, len(keys)) if self.per_minute else self.partitions
        spacing = 60.0 / self.per_minute if self.per_minute else 0.0
        waits = [0.0] * tries
        if self.backoff:
            row = requests.sparkSession.range(1).select(*[BACKOFFS[self.backoff](F.lit(float(n))).cast("double").alias(f"w{n}") for n in range(tries)]).first()
            waits = list(row)

        def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = connect(keys[TaskContext.get().partitionId() % len(keys)]) if keys else connect()
            free = 0.0
            for batch in batches:
                rows = []
                for key, request in zip(batch["key"], batch["request"], strict=True):
                    response = error = None
                    for attempt in range(tries):
                        time.sleep(max(0.0, free - time.monotonic()))
                        free = time.monotonic() + spacing
                        try:
                            response, error = call(request), None
                            break
                        except Exception as problem:  # a failed request is a row, not a failed job
                            error = f"{type(problem).__name__}: {problem}"[:500]
                            if attempt + 1 < tries:
                                time.sleep(waits[attempt])
                    rows.append((key, request, response, error, pd.Timestamp.now("UTC").tz_localize(None)))
                yield pd.DataFrame(rows, columns=["key", "request", "response", "error", "created_at"])

        return requests.select("key", "request").repartition(partitions, "key").mapInPandas(called, RESPONSES)


def resolve(requests: DataFrame, store: DataFrame, request: str, provider: Provider | None = None, model: str = "") -> tuple[DataFrame, DataFrame]:
    """(requests with response and error, the new store).  Without a provider, misses get an error."""
    keyed = requests.withColumn("key", request_key(F.col(request), model))
    if provider is not None:
        # written before anything joins it: later steps and actions read the answers, none asks again
        new = stored(provider.answer(misses(keyed.withColumn("request", F.col(request)), store)), "responses")
        store = upsert(store, new)
    answered = keyed.join(store.select("key", "response", "error"), "key", "left")
    missing = F.col("response").isNull() & F.col("error").isNull()
    return answered.withColumn("error", F.when(missing, "no stored response").otherwise(F.col("error"))).drop("key"), store
