"""Scoring of transcripts, and accuracy by dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions import text as T

#: Scorers by name: (output, golds, judge verdicts) -> score.  Registering another name adds a column.
SCORERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "em_score_mcq": lambda output, golds, verdict: T.letter_correct(T.mcq_letter(output), golds).cast("double"),
    "llm_score": lambda output, golds, verdict: F.when(T.exact_match(T.free_answer(output), golds), 1.0).otherwise(
        F.coalesce(F.array_max(F.transform(verdict, T.judge_score)), F.lit(0.0))
    ),
}


def check_methods(methods: list[str]) -> list[str]:
    """The scoring methods in a fixed order; unknown or no methods are an error."""
    unknown = sorted(set(methods) - set(SCORERS))
    if unknown or not methods:
        raise ValueError(f"scoring methods must be among {sorted(SCORERS)}; got {sorted(methods)}")
    return sorted(set(methods))


def score(samples: DataFrame, methods: list[str]) -> DataFrame:
    """Adds a column a method to (output, golds, verdicts, error); a failed sample scores 0."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return samples.withColumns({m: F.when(failed, 0.0).otherwise(SCORERS[m](F.col("output"), F.col("golds"), F.col("verdicts"))) for m in check_methods(methods)})


def dataset_stats(results: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Counts and accuracies by dataset; listed datasets without rows get zeros, unlisted ones are left out.

    One partial aggregation per task, one row a dataset through the shuffle.
    """
    correct = lambda c: F.count_if(F.col(c) > 0.5)
    stats = results.groupBy("dataset").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
        correct("em_score_mcq").alias("em_correct"),
        F.count("em_score_mcq").alias("em_total"),
        correct("llm_score").alias("llm_correct"),
        F.count("llm_score").alias("llm_total"),
    )
    counts = stats.columns[1:]
    if datasets is not None:
        stats = datasets.select("dataset").distinct().join(stats, "dataset", "left").fillna(0, counts)
    return stats.withColumns({"em_accuracy": F.try_divide("em_correct", "em_total"), "llm_accuracy": F.try_divide("llm_correct", "llm_total")})


def best_over_golds(pairs: DataFrame) -> DataFrame:
    """(sample_id, score): the best score over the gold answers of (sample_id, gold, score)."""
    return pairs.groupBy("sample_id").agg(F.max("score").alias("score"))


def error_histogram(errors: Column, rows: DataFrame) -> DataFrame:
    """(code, n): failures by HTTP code, ``unknown`` without one."""
    return rows.groupBy(F.coalesce(T.http_code(errors), F.lit("unknown")).alias("code")).agg(F.count("*").alias("n"))
