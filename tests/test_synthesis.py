"""Providers, configuration, sinks and rules that the catalogue's tables do not reach."""

import json
import time

import pytest
from pyspark.sql import functions as F

from hopweave.functions import text as T
from hopweave.operators import quality, synthesis
from hopweave.plans import pipelines
from hopweave.sources import config, pages, provider, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Literals worked out by hand from the survey's rules.
@pytest.mark.parametrize(
    ("output", "letter", "answer"),
    [
        ("<answer>\nb\n</answer>", "B", "b"),
        ("<answer>\t\u00a0C \r\n</answer>", "C", "C"),
        ("so \\boxed{\n d }", "D", "so \\boxed{\n d }"),
        ("<think>x</think>\n\u3000Paris\n\n", None, "Paris"),
        ("<answer>none</answer> (A)", None, "none"),
    ],
)
def test_white_space_around_answers(spark, output, letter, answer):
    assert (one(spark, T.mcq_letter(F.lit(output))), one(spark, T.free_answer(F.lit(output)))) == (letter, answer)


def test_strip_rules(spark):
    assert one(spark, T.strip_think(F.lit("<think>a\nb</think>\n\n\t shown\n"))) == "shown"
    assert one(spark, T.squeeze(F.lit("a\u00a0\u3000b \x1c c"))) == "a b c"
    assert one(spark, T.tool_call(F.lit('<tool_call>\n\n{"name": "zoom"}\n</tool_call>')))["name"] == "zoom"


@pytest.mark.parametrize(
    ("text", "sliced"),
    [
        ('```json\n{"a": {"b": 1}}\nand {"c": 2}\n```', '{"a": {"b": 1}}'),
        ('x {"a": 1} y {"b": 2} z', '{"a": 1} y {"b": 2}'),
        ('say {"a": [1, 2', '{"a": [1, 2'),
        ("no braces", None),
    ],
)
def test_json_slice(spark, text, sliced):
    assert one(spark, T.json_slice(F.lit(text))) == sliced


def counting(folder, answer):
    """A provider's connect() that leaves a file for every call."""

    def connect():
        import os
        import uuid

        def call(request):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
                file.write(request)
            return answer(request)

        return call

    return connect


def calls(folder):
    return len(list(folder.iterdir()))


def empty_store(spark):
    return spark.createDataFrame([], provider.RESPONSES)


def test_equal_requests_are_sent_once(spark, tmp_path):
    asks = spark.createDataFrame([(1, "q one"), (2, "Q  one"), (3, "q two")], "id int, question string")
    client = provider.Provider(counting(str(tmp_path), lambda r: r.upper()))
    answered, store = provider.resolve(asks, empty_store(spark), "question", client)
    for _ in range(3):
        assert answered.count() == 3 and {r["error"] for r in answered.collect()} == {None} and store.count() == 2
    again, store = provider.resolve(asks, store, "question", client)
    assert again.count() == 3 and store.count() == 2 and calls(tmp_path) == 2


def test_agent_turns_call_once_a_key(spark, tmp_path):
    samples = spark.createDataFrame([("s", "where?")], "id string, question string")
    tools = spark.createDataFrame([("search", "x", "found x")], "name string, query string, result string")
    say = lambda r: "done" if r.count("found x") == 2 else '<tool_call>{"name": "search", "arguments": {"query": "x"}}</tool_call>'
    done, store = pipelines.agent_turns(samples, empty_store(spark), tools, provider.Provider(counting(str(tmp_path), say)))
    assert [(r["turns"], r["finish_reason"]) for r in done.collect()] == [(3, "stop")]
    assert done.count() == 1 and store.count() == 3 and calls(tmp_path) == 3


def test_evaluate_and_retrieve_call_once_a_key(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "r").mkdir()
    samples = spark.createDataFrame([("a", "d", "q?", ["x", "y"]), ("b", "d", "q?", ["x"])], "id string, dataset string, question string, answer array<string>")
    client = provider.Provider(counting(str(tmp_path / "e"), lambda r: "<judge>yes</judge>" if "Judge" in r else "out"))
    scored, stats, store = pipelines.evaluate(samples, empty_store(spark), ["llm_score"] + ["em_score_mcq"], client, client)
    assert scored.count() == 2 and stats.count() == 1 and scored.agg(F.sum("llm_score")).first()[0] == 2.0
    assert store.count() == 3 and calls(tmp_path / "e") == 3  # one question, two pairs with golds
    results = spark.createDataFrame([("q", 0, "t", "s", "http://a/1"), ("q", 1, "u", "v", "http://a/2")], "query string, ord int, title string, snippet string, link string")
    html = spark.createDataFrame([("http://a/1", "<p>one</p>"), ("http://a/2", "<p>two</p>")], "url string, html string")
    found, store = pipelines.retrieve(results.select("query"), results, html, empty_store(spark), provider.Provider(counting(str(tmp_path / "r"), lambda r: "sum")))
    assert [r["summary"] for r in found.collect()] == ["sum"] and found.count() == 1
    assert calls(tmp_path / "r") == 3


def test_failures_wait_and_are_rows(spark):
    def connect(key):
        tried = []

        def call(request):
            tried.append(request)
            if request == "bad" or len(tried) == 1:
                raise ValueError("HTTP 429")
            return f"{request} by {key}"

        return call

    asks = spark.createDataFrame([("good",), ("bad",)], "question string").coalesce(1)
    client = provider.Provider(connect, tries=2, keys=("k1",), per_minute=600, backoff="query_cache")
    begun = time.monotonic()
    rows = {r["question"]: r for r in provider.resolve(asks, empty_store(spark), "question", client)[0].collect()}
    assert time.monotonic() - begun >= 0.3  # four tries of one key, a tenth of a second apart
    assert rows["good"]["response"] == "good by k1" and rows["bad"]["error"] == "ValueError: HTTP 429"


def test_assigned_keys(spark):
    keys = [r["k"] for r in spark.range(50).select(synthesis.assigned_key(F.col("id"), ["a", "b", "c"]).alias("k")).collect()]
    assert set(keys) == {"a", "b", "c"}


def test_configuration():
    section = config.tool_section(json.dumps({"tools": [{"tool_schema": {"name": "zoom"}}, {}]}))
    assert '<tools>\n{"name": "zoom"}\n{}\n</tools>' in section and section.startswith("# Tools")
    assert config.rates('{"model_rpm": {"default": 5, "m": 7}}') == {"default": 5.0, "m": 7.0}
    assert config.rates("{broken") == config.rates(None) == {"default": 20}
    assert config.api_keys(" a, ,b") == ["a", "b"]
    from datetime import datetime

    assert config.output_name("run", datetime(2024, 1, 2, 3, 4, 5)) == "run_20240102_030405"
    assert config.questions_path("f", {"synthesis_final_results.json", "questions_raw.json"}) == "f/questions_raw.json"
    assert config.questions_path("f", {"synthesis_final_results.json"}) == "f/synthesis_final_results.json"


def test_reloads_and_envelope(spark, tmp_path):
    questions = spark.createDataFrame([("q1", "a?"), ("q2", "b?")], "id string, question string")
    envelope = json.loads(sinks.final_results({"questions": questions, "errors_seen": questions.limit(0)}, {"seconds": 1}, ["e"], str(tmp_path / "out"), "now"))
    assert (envelope["questions_count"], envelope["errors_seen_count"], envelope["errors"], envelope["generated_at"]) == (2, 0, ["e"], "now")
    assert config.read_stage(spark, envelope["questions"], "id string, question string").count() == 2
    (tmp_path / "stage.json").write_text('[\n{"id": "x",\n "question": "y"}]')
    assert [tuple(r) for r in config.read_stage(spark, str(tmp_path / "stage.json"), "id string, question string").collect()] == [("x", "y")]
    path = str(tmp_path / "snapshot")
    sinks.write_new(questions, questions.limit(0), "id", path)
    sinks.write_new(questions.union(spark.createDataFrame([("q3", "c?")], questions.schema)), spark.read.json(path), "id", path)
    assert sorted(r["id"] for r in spark.read.json(path).collect()) == ["q1", "q2", "q3"]
    text = sinks.console_summary(synthesis.stage_counts({"questions": questions}), synthesis.mean_scores(spark.createDataFrame([(0.5, None)], "difficulty_score double, uniqueness_score double")), [str(i) for i in range(9)])
    assert text.splitlines()[:3] == ["questions: 2", "mean_difficulty_score: 0.500", "mean_uniqueness_score: 0.000"] and text.count("error") == 5


def test_viewer_escapes_and_shows(spark):
    rows = spark.createDataFrame([('<b id="1">', "look [IMAGE 1]", 0.5, "x" * 300, ["data:image/png;base64,AA"])], "sample_id string, output string, score double, note string, images array<string>")
    page = sinks.viewer(rows)
    assert "<b id" not in page and "&lt;b id=&quot;1&quot;&gt;" in page
    assert '<img src="data:image/png;base64,AA">' in page and "score: 0.5000" in page and "xxx" not in page


def test_conditionless_questions_have_a_row(spark):
    questions = spark.createDataFrame([("a", "q", "gold", ["c1", "c2"]), ("b", "q", "gold", [])], "question_id string, question string, expected string, conditions array<string>")
    items = quality.ablation_items(questions)
    answers = spark.createDataFrame([("a", 0, "the gold one")], "question_id string, condition_index int, answer string")
    rows = {r["question_id"]: r for r in quality.ablation_summary(quality.ablation_results(items, answers), questions).collect()}
    assert (rows["a"]["critical"], rows["a"]["redundant"], rows["a"]["redundancy_ratio"]) == ([1], [0], 0.5)
    assert (rows["b"]["critical"], rows["b"]["redundancy_ratio"], rows["b"]["total"]) == ([], 0.0, 0)


def test_guard_lets_other_missing_modules_through():
    source = open("__spark_entry__.py").read()
    assert "except ImportError" not in source and "ModuleNotFoundError" in source
    assert pages is not None
