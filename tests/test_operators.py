"""Operators on small fixtures: scans, caches, merges, paths, quality rounds, pipelines, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from hopweave.operators import graph, keyed, merge, quality, scoring
from hopweave.plans import pipelines
from hopweave.sources import annotations, provider, sinks
from hopweave.streaming.results import score_stream


def raw(question, gold):
    return {"prompt": [{"role": "user", "content": f"<image>{question} "}], "reward_model": {"ground_truth": [gold]}, "image": ["a.png"]}


def test_permissive_lines_use_their_index(spark, tmp_path):
    file = tmp_path / "a.jsonl"
    file.write_text("[\n" + json.dumps(raw("q0", "A")) + ",\n{broken\n\n" + json.dumps(raw("q2", "B")) + "\n]\n")
    config = annotations.DatasetConfig("d", str(file), "/data", ["em_score_mcq"])
    rows = annotations.load_datasets(spark, [config, annotations.DatasetConfig("none", str(tmp_path / "missing"), "", ["llm_score"])]).orderBy("id").collect()
    assert [(r["id"], r["question"], r["answer"], r["image_path"]) for r in rows] == [("d-0", "q0", ["A"], "/data/a.png"), ("d-2", "q2", ["B"], "/data/a.png")]


def test_json_array(spark, tmp_path):
    file = tmp_path / "a.json"
    file.write_text("\n" + json.dumps([raw("q0", "A"), raw("q1", "B")]))
    assert annotations.json_rows(spark, str(file), annotations.RAW).count() == 2


def test_unknown_scorer():
    with pytest.raises(ValueError):
        scoring.check_methods(["other"])


def test_upsert_and_lookup(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], "key string, value string, created_at int")
    new = spark.createDataFrame([("b", "4", 2)], "key string, value string, created_at int")
    store = keyed.upsert(rows, new)
    assert {(r["key"], r["value"]) for r in store.collect()} == {("a", "2"), ("b", "4")}
    asked = spark.createDataFrame([("a",), ("c",), ("c",)], "key string")
    assert keyed.hit_stats(keyed.lookup(asked, store)).first().asDict() == {"hits": 1, "misses": 2, "hit_rate": pytest.approx(1 / 3)}
    assert [r["key"] for r in keyed.misses(asked, store).collect()] == ["c"]


def test_merge_first_wins(spark):
    rows = spark.createDataFrame([("s", 2, "B_x", "late", "e2", ["u"]), ("s", 1, "b X", "", "e1", ["t"])], "src string, ord int, entity string, description string, evidence string, sources array<string>")
    row = merge.merge_candidates(rows).first()
    assert (row["entity"], row["description"], row["evidence"], row["sources"]) == ("b X", "late", "e1 e2", ["t", "u"])


def test_paths_are_acyclic_and_exact(spark):
    edges = spark.createDataFrame([("a", "b", "r", 0.95), ("b", "a", "r", 0.95), ("b", "c", "s", 0.9), ("a", "d", "r", 0.99)], "src string, dst string, relation string, confidence double")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert [r["nodes"] for r in graph.expand_paths(seeds, edges, 2).collect()] == [["a", "b", "c"]]
    assert graph.expand_paths(seeds, edges, 3).count() == 0
    assert graph.relation_dim(spark).count() == 65


def test_claim_once(spark):
    paths = spark.createDataFrame([("a", ["a", "x", "y"], ["r", "r"]), ("b", ["b", "x", "z"], ["r", "r"]), ("b", ["b", "q", "w"], ["r", "r"])], "seed string, nodes array<string>, relations array<string>")
    assert {tuple(r["nodes"]) for r in graph.claim_once(paths).collect()} == {("a", "x", "y"), ("b", "q", "w")}


def test_merge_nodes(spark):
    row = spark.range(1).select(graph.merge_nodes(F.array(*map(F.lit, "abcd")), F.array(F.lit("d"), F.lit("b")), F.lit("m")).alias("n")).first()
    assert row["n"] == ["a", "m", "c"]


def test_rewrite_rounds(spark):
    questions = spark.createDataFrame([(1, "leak leak"), (2, "fine"), (3, "leak leak leak")], "original_index int, question string")
    judge = lambda q: q.select("original_index", F.lit(True).alias("solved"), F.contains("question", F.lit("leak")).alias("leaked"), F.lit(False).alias("model_issue"), F.lit(1).alias("ord"))
    rewrite = lambda q: q.select("original_index", F.when(F.col("original_index") == 1, "clean").otherwise(F.col("question")).alias("question"))
    assert {(r["original_index"], r["question"]) for r in quality.rewrite_rounds(questions, judge, rewrite).collect()} == {(1, "clean"), (2, "fine")}


def test_judge_report(spark):
    text = "### original_index=3, solve_result=correct\n- leakage_detected: true\n- leakage_reason: year\n### original_index=4, solve_result=incorrect\n- model_issue: true"
    rows = {r["original_index"]: r for r in quality.judge_report(spark.createDataFrame([(1, text)], "id int, text string")).collect()}
    assert rows[3]["leakage_detected"] and rows[3]["leakage_reason"] == "year" and rows[3]["solve_result"] == "correct"
    assert rows[4]["model_issue"] and not rows[4]["leakage_detected"] and rows[4]["leakage_type"] == "none"


def test_evaluation_replays(spark):
    samples = spark.createDataFrame([("d-0", "d", "q one", ["A"]), ("d-1", "d", "q two", ["B"])], "id string, dataset string, question string, answer array<string>")
    store = spark.createDataFrame([], provider.RESPONSES)
    client = provider.Provider(lambda: lambda q: "<answer>A</answer>" if "one" in q else 1 / 0, tries=1, partitions=2)
    judge = provider.Provider(lambda: lambda q: "<judge>No</judge>", partitions=2)
    results, stats, store = pipelines.evaluate(samples, store, ["em_score_mcq", "llm_score"], client, judge)
    assert stats.first().asDict()["errors"] == 1 and stats.first()["em_correct"] == 1
    assert {r["sample_id"]: r["llm_score"] for r in results.collect()} == {"d-0": 1.0, "d-1": 0.0}
    assert json.loads(sinks.summary(stats))["d"]["total"] == 2


def test_agent(spark):
    call = '<tool_call>{"name": "search", "arguments": {"query": "k"}}</tool_call>'
    client = provider.Provider(lambda: lambda q: "<answer>B</answer>" if "found it" in q else call, partitions=2)
    samples = spark.createDataFrame([("1", "start")], "id string, question string")
    tools = spark.createDataFrame([("search", "k", "found it")], "name string, query string, result string")
    row = pipelines.agent_turns(samples, spark.createDataFrame([], provider.RESPONSES), tools, client, 3)[0].first()
    assert row["turns"] == 2 and row["finish_reason"] == "stop" and row["output"].endswith("<answer>B</answer>")


def test_stream_appends(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    line = {"sample_id": "1", "dataset": "d", "output": "<answer>A</answer>", "golds": ["a"], "verdicts": []}
    for n in range(2):  # the second run takes only the new file
        (source / f"{n}.json").write_text(json.dumps(line))
        score_stream(spark, str(source), str(sink), str(tmp_path / "check"), ["em_score_mcq"]).awaitTermination()
    assert [r["em_score_mcq"] for r in spark.read.json(str(sink)).collect()] == [1.0, 1.0]


def test_synthesis(spark):
    seeds = pipelines.entities(spark, ["Nike Logo", "nike"])
    assert [r["cleaned_name"] for r in seeds.collect()] == ["Nike"]
    edges = spark.createDataFrame([("Nike", "b", "founded_by", 0.95), ("b", "c", "spouse", 0.5), ("b", "d", "child", 0.91)], "src string, dst string, relation string, confidence double")
    row = pipelines.synthesize(seeds, edges, 2, 3, 1).first()
    assert row["nodes"] == ["Nike", "b", "d"] and row["diversity"] == pytest.approx(0.58)
