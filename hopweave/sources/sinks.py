"""Sinks: results, summaries, training exports, call logs, the HTML viewer."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions.text import highlight, html_escape, redact

#: Columns that never reach the results.
UNSAVED = ("saved_images", "tool_calls")


def append_results(results: DataFrame, path: str, resume: bool = True) -> None:
    results.drop(*UNSAVED).write.mode("append" if resume else "overwrite").json(path)


def summary(stats: DataFrame, fetches: DataFrame | None = None) -> str:
    """JSON of the statistics (a row a dataset) and, if given, the failures by code."""
    out: dict = {row["dataset"]: {k: v for k, v in row.asDict().items() if k != "dataset" and v is not None} for row in stats.orderBy("dataset").collect()}
    if fetches is not None:
        out["web_fetch"] = {"errors_by_code": {r["code"]: r["n"] for r in fetches.orderBy("code").collect()}}
    return json.dumps(out, ensure_ascii=False, indent=2)


def write_stage(rows: DataFrame, folder: str, stage: str) -> DataFrame:
    """Writes a stage and reads it back, so later stages do not recompute it."""
    rows.write.mode("overwrite").parquet(f"{folder}/{stage}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{stage}")


def final_results(stages: dict[str, DataFrame], statistics: dict, errors: list[str], folder: str, at: str) -> str:
    """Writes every stage as JSON lines below ``folder``; returns the envelope: counts, statistics, errors, where the rows are."""
    out: dict = {"generated_at": at, "statistics": statistics, "errors": errors}
    for name, rows in stages.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
        out[f"{name}_count"], out[name] = rows.sparkSession.read.schema(rows.schema).json(f"{folder}/{name}").count(), f"{folder}/{name}"
    return json.dumps(out, ensure_ascii=False, indent=2)


def write_new(rows: DataFrame, written: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key is not written yet: a snapshot grows by what is new."""
    rows.join(written.select(key), key, "left_anti").write.mode("append").json(path)


def console_summary(counts: DataFrame, scores: DataFrame, errors: list[str], most: int = 5) -> str:
    """The lines a run ends with: a count a stage, mean scores, the first errors."""
    lines = [f"{r['stage']}: {r['n']}" for r in counts.orderBy("stage").collect()]
    lines += [f"{name}: {value:.3f}" for name, value in scores.first().asDict().items() if value is not None]
    return "\n".join(lines + [f"error: {e}" for e in errors[:most]])


def or_default(column: str, default: Column) -> Column:
    return F.coalesce(F.col(column), default).alias(column)


def training_export(questions: DataFrame) -> DataFrame:
    """The fixed projection of questions for training, with defaults."""
    text, none = F.lit(""), F.array().cast("array<string>")
    defaults = {"id": text, "question": text, "answer": text, "constraints": none, "reasoning_path": none, "difficulty_score": F.lit(0.5), "uniqueness_score": F.lit(0.5), "evidence": text}
    return questions.select(*[or_default(c, d) if c in questions.columns else d.alias(c) for c, d in defaults.items()])


def visual_export(items: DataFrame) -> DataFrame:
    """Training projection of visual questions: the local image, else the first address that is no inline data."""
    shown = F.coalesce(F.nullif(F.col("local_image_path"), F.lit("")), F.when(~F.startswith("image_url", F.lit("data:")), F.col("image_url")), F.lit(""))
    keep = ["id", "question", "answer", "original_question", "original_answer", "target_entity", "visual_reference", "entity_type", "difficulty", "domain", "reasoning_path"]
    return items.select(*keep, shown.alias("image"))


def call_log(calls: DataFrame) -> DataFrame:
    return calls.withColumns({"request": redact(F.col("request"), 10_000), "error": redact(F.col("error"))})


def viewer(results: DataFrame, most: int = 200) -> str:
    """A self-contained HTML page of at most ``most`` results (a report, not the sink).

    Image marks become images of the column ``images`` if there is one; other
    columns are listed below: numbers with four decimals, strings under 200 characters.
    """
    kinds = dict(results.dtypes)
    shown = {c: F.format_string("%.4f", c) if kinds[c] in ("double", "float") else F.when(F.length(c) < 200, html_escape(F.col(c))) for c in results.columns if kinds[c] in ("double", "float", "string") and c not in ("sample_id", "output")}
    body = highlight(F.col("output"))
    if "images" in results.columns:
        marks = F.transform("images", lambda source, i: F.struct(F.concat(F.lit("[IMAGE "), (i + 1).cast("string"), F.lit("]")).alias("mark"), source.alias("source")))
        body = F.aggregate(marks, body, lambda text, m: F.replace(text, m["mark"], F.concat(F.lit('<img src="'), html_escape(m["source"]), F.lit('">'))))
    facts = F.concat_ws("<br>", *[F.concat(F.lit(f"{c}: "), value) for c, value in shown.items()])
    rows = results.orderBy("sample_id").limit(most).select(html_escape(F.col("sample_id")).alias("id"), body.alias("body"), facts.alias("facts")).collect()
    return "<!doctype html><meta charset=utf-8>" + "".join(f"<h2>{r['id']}</h2><div>{r['body']}</div><p>{r['facts']}</p>" for r in rows)
