"""The three pipelines over DataFrames; every model or web call goes through ``resolve``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions import numeric as N
from hopweave.functions import predicates as P
from hopweave.functions import text as T
from hopweave.operators import graph
from hopweave.operators.merge import first_wins
from hopweave.operators.scoring import dataset_stats, score
from hopweave.sources.provider import Provider, resolve


def evaluate(samples: DataFrame, store: DataFrame, methods: list[str], provider: Provider | None = None, judge: Provider | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, statistics, store) of samples (id, dataset, question, answer): answer, judge each gold, score, count."""
    answered, store = resolve(samples, store, "question", provider, "answer")
    results = answered.select(F.col("id").alias("sample_id"), "dataset", "question", F.col("response").alias("output"), F.col("answer").alias("golds"), "error")
    pairs = results.select("sample_id", F.explode("golds").alias("gold"), F.concat_ws("\n", F.lit("Judge whether the response means the reference."), F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Reference: "), "gold"), F.concat(F.lit("Response: "), T.free_answer(F.col("output")))).alias("request"))
    judged, store = resolve(pairs, store, "request", judge, "judge")
    verdicts = judged.groupBy("sample_id").agg(F.collect_list("response").alias("verdicts"))
    scored = score(results.join(verdicts, "sample_id", "left"), methods)
    return scored, dataset_stats(scored, samples.select("dataset")), store


def agent_turns(samples: DataFrame, store: DataFrame, tools: DataFrame, provider: Provider | None = None, most_turns: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rounds of model call and tool result, all open samples at once.

    ``samples``: (id, question); ``tools``: (name, query, result).  A sample
    stops without a tool call, on an error or after the last turn.
    """
    open_ = samples.select("id", F.col("question").alias("context"), F.lit(0).alias("turns"))
    done = None
    for turn in range(1, most_turns + 1):
        answered, store = resolve(open_, store, "context", provider, "agent")
        call = T.tool_call(F.col("response"))
        answered = answered.withColumns({"turns": F.lit(turn), "call": call})
        stop = F.col("call").isNull() | F.col("error").isNotNull() | (F.lit(turn) == most_turns)
        why = F.when(F.col("error").isNotNull(), "error").when(F.col("call").isNull(), "stop").otherwise("max_turns")
        closed = answered.where(stop).select("id", F.concat_ws("\n", "context", "response").alias("output"), "turns", why.alias("finish_reason"), "error")
        done = closed if done is None else done.unionByName(closed)
        going = answered.where(~stop).withColumns({"name": F.col("call.name"), "query": F.col("call.arguments")["query"]})
        heard = F.coalesce(F.col("result"), F.concat(F.lit("Unknown tool or no result: "), "name"))
        open_ = going.join(tools, ["name", "query"], "left").select("id", F.concat_ws("\n", "context", "response", F.concat(F.lit("<tool_response>"), heard, F.lit("</tool_response>"))).alias("context"), "turns")
    return done, store


def retrieve(queries: DataFrame, results: DataFrame, pages: DataFrame, store: DataFrame, provider: Provider | None = None, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Search, fetch the first pages, summarise each, and summarise the whole: (query, context, summary, error)."""
    ranked = graph.top(results.where(~P.skipped_url(F.col("link"))), ["query"], [F.col("ord")], depth)
    read = ranked.join(pages.select(F.col("url").alias("link"), "html"), "link", "left").withColumn("content", F.left(T.html_text(F.col("html")), F.lit(30_000)))
    asked = read.withColumn("request", F.concat_ws("\n", F.concat(F.lit("Summarise for: "), "query"), F.coalesce("content", "snippet")))
    summed, store = resolve(asked, store, "request", provider, "summary")
    per_query = summed.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", F.coalesce("response", "snippet").alias("snippet"), "link"))), lambda r: F.struct(r["title"].alias("title"), T.strip_think(r["snippet"]).alias("snippet"), r["link"].alias("link"))).alias("found"))
    whole = queries.select("query").distinct().join(per_query, "query", "left").withColumn("context", T.search_context(F.col("query"), F.coalesce("found", F.array().cast("array<struct<title:string,snippet:string,link:string>>"))))
    final, store = resolve(whole, store, "context", provider, "final")
    return final.select("query", "context", T.strip_think(F.col("response")).alias("summary"), "error"), store


def entities(spark, names: list[str]) -> DataFrame:
    """Provided names as entity rows; two demonstration names if there are none."""
    listed = spark.createDataFrame(list(enumerate(names or ["Eiffel Tower", "Mount Fuji"])), "ord int, name string")
    cleaned = listed.withColumns({"cleaned_name": T.clean_entity(F.col("name")), "source": F.lit("provided" if names else "default")})
    return first_wins(cleaned, F.lower("cleaned_name"))


def synthesize(seeds: DataFrame, edges: DataFrame, depth: int, beam: int, chains_per_seed: int) -> DataFrame:
    """Evidence chains of each seed (ord, cleaned_name): valid edges, fixed depth, the most diverse first."""
    good = edges.where(P.valid_edge(F.col("confidence"), F.col("relation")))
    paths = graph.expand_paths(seeds.select(F.col("cleaned_name").alias("seed")), good, depth, beam)
    scored = paths.withColumn("diversity", N.diversity(F.col("nodes"), F.col("relations")))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("diversity").desc(), "nodes"))
    return scored.withColumn("place", place).where(F.col("place") <= chains_per_seed).withColumn("evidence", graph.render_path(F.col("nodes"), F.col("relations")))


def fuse_answers(chains: DataFrame, rule: str, least: int = 2) -> DataFrame:
    """Per question the fusion of its answers (question_id, ord, answer, method, reported), in order."""
    valued = chains.withColumn("value", N.answer_value(F.col("answer"), F.col("method"), F.col("reported")))
    listed = valued.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("values"))
    fused = listed.where(F.size("values") >= least)
    return fused.select("question_id", "values", N.fuse(F.col("values"), F.lit(rule)).alias("result"), N.fusion_text(F.col("values"), F.lit(rule)).alias("description"))
