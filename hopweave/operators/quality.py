"""Question quality: leak routing with rewrite rounds, condition ablation, judge reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions import predicates as P


def route(questions: DataFrame, judgments: DataFrame) -> DataFrame:
    """Adds ``route`` to questions (original_index, ...); the last judgment of an index counts, none keeps."""
    last = judgments.groupBy("original_index").agg(F.max_by(F.struct("solved", "leaked", "model_issue"), "ord").alias("j"))
    return questions.join(last, "original_index", "left").withColumn("route", P.leak_route(F.col("j.solved"), F.col("j.leaked"), F.col("j.model_issue"))).drop("j")


def rewrite_rounds(questions: DataFrame, judge: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """Judges, rewrites what leaks, and judges again; what still leaks after the last round is dropped.

    ``judge`` returns judgments, ``rewrite`` (original_index, question) for the
    questions it is given.  Only rewrites that pass replace a question.
    """
    routed = route(questions, judge(questions))
    done = routed.where("route != 'rewrite'").drop("route")
    open_ = routed.where("route = 'rewrite'").drop("route")
    for _ in range(rounds):
        new = open_.drop("question").join(rewrite(open_), "original_index").select(*questions.columns)
        routed = route(new, judge(new))
        passed = routed.where("route != 'rewrite'").drop("route")
        done = done.unionByName(passed)
        open_ = open_.join(passed.select("original_index"), "original_index", "left_anti")
    return done


def ablation_items(questions: DataFrame, most: int = 5) -> DataFrame:
    """One row a question and condition, the condition left out of the conditions."""
    every = questions.select("question_id", "question", "expected", "conditions", F.posexplode(F.slice("conditions", 1, most)).alias("condition_index", "condition_text"))
    rest = F.array_join(F.filter("conditions", lambda c, i: i != F.col("condition_index")), " ")
    return every.withColumn("ablated", rest).drop("conditions")


def ablation_results(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds whether the solver was right without the condition, and whether the condition is critical."""
    known = items.join(answers, ["question_id", "condition_index"], "left")
    right = P.covers(F.col("answer"), F.col("expected"))
    return known.withColumns({"solver_correct": right, "condition_critical": ~right})


def ablation_summary(results: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Per question its critical and redundant conditions and the share of the redundant.

    With ``questions`` (question_id) also those without conditions: none critical, share 0.
    """
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("condition_index"))))
    found = results.groupBy("question_id").agg(
        listed(F.col("condition_critical")).alias("critical"),
        listed(~F.col("condition_critical")).alias("redundant"),
        F.avg((~F.col("condition_critical")).cast("double")).alias("redundancy_ratio"),
        F.count("*").alias("total"),
    )
    if questions is None:
        return found
    none = F.array().cast("array<int>")
    return questions.select("question_id").distinct().join(found, "question_id", "left").select(
        "question_id", F.coalesce("critical", none).alias("critical"), F.coalesce("redundant", none).alias("redundant"), F.coalesce("redundancy_ratio", F.lit(0.0)).alias("redundancy_ratio"), F.coalesce("total", F.lit(0)).alias("total")
    )


def judge_report(reports: DataFrame, text: str = "text") -> DataFrame:
    """Parses markdown judge reports: a section per question, ``- field: value`` lines below it."""
    lines = reports.select(F.posexplode(F.split(text, "\n")).alias("pos", "line"), *[c for c in reports.columns if c != text])
    keys = [c for c in reports.columns if c != text]
    head = F.regexp_extract("line", r"^###\s*original_index=(\d+)", 1)
    section = F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("pos"))
    fields = lines.withColumn("original_index", section.cast("int")).where("original_index IS NOT NULL")
    value = lambda name: F.max_by(F.nullif(F.regexp_extract("line", rf"^-\s*{name}:\s*(.*)$", 1), F.lit("")), F.when(F.col("line").rlike(rf"^-\s*{name}:"), F.col("pos")))
    true = lambda name: F.coalesce(F.lower(F.trim(value(name))) == "true", F.lit(False))
    return fields.groupBy(*keys, "original_index").agg(
        F.max(F.nullif(F.regexp_extract("line", r"solve_result=(\w+)", 1), F.lit(""))).alias("solve_result"),
        true("leakage_detected").alias("leakage_detected"),
        F.coalesce(value("leakage_type"), F.lit("none")).alias("leakage_type"),
        true("model_issue").alias("model_issue"),
        F.coalesce(value("leakage_reason"), F.lit("")).alias("leakage_reason"),
        F.coalesce(value("judge_feedback"), F.lit("")).alias("judge_feedback"),
    )


def positional(rows: DataFrame, picks: DataFrame, candidates: str, picked: str) -> DataFrame:
    """Rows that a list of 1-based positions picks from an array column; out-of-range positions drop out."""
    numbered = rows.select("id", F.posexplode(candidates).alias("place", "value"))
    return picks.select("id", F.posexplode(picked).alias("rank", "index")).join(numbered.withColumn("index", F.col("place") + 1), ["id", "index"]).select("id", "rank", "index", "value")


def entities_in(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, entity): names that occur in a question, or half of whose words do.

    Joins on words instead of comparing every pair: a name can only match where
    one of its words occurs.  Questions are read again only for names that
    might occur with their first or last word cut.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    asked = questions.select("question_id", F.explode(words(F.col("question"))).alias("word"))
    named = entities.select("entity", F.size(words(F.col("entity"))).alias("n"), F.explode(words(F.col("entity"))).alias("word"))
    shared = asked.join(named, "word").groupBy("question_id", "entity").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    half = (F.col("n") >= 2) & (F.col("shared") * 2 >= F.col("n"))
    maybe = shared.where(~half).join(questions.select("question_id", "question"), "question_id").where(F.contains(F.lower("question"), F.lower("entity")))
    return shared.where(half).select("question_id", "entity").unionByName(maybe.select("question_id", "entity"))
