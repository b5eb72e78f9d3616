"""Results as they finish: a file stream that scores and appends, with resume by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hopweave.operators.scoring import score
from hopweave.sources.sinks import append_results

SAMPLES = "sample_id string, dataset string, output string, golds array<string>, verdicts array<string>, error string"


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, methods: list[str]) -> StreamingQuery:
    """Scores transcripts that arrive as JSON files and appends them; a restart continues where it stopped."""
    arriving = spark.readStream.schema(SAMPLES).json(source)
    return score(arriving, methods).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, _: append_results(rows, sink)).start()


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Windowed counts by type with a watermark, for batch and streaming inputs alike."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
