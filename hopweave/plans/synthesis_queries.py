"""Queries of the synthesis stages and of the rules beside them, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.functions import numeric as N
from hopweave.functions import predicates as P
from hopweave.functions import responses as R
from hopweave.functions import text as T
from hopweave.operators import graph, keyed, merge, quality, scoring, synthesis
from hopweave.plans.catalogue import query, read
from hopweave.sources import config, sinks


def _in(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: An order of line items without ties that would matter.
_ORD = "(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + CAST(l_quantity AS BIGINT))"


# ---- claims, labels, properties

#: Line items as claims: an order claims a part under one of three properties, the last of which is no relation.
_CLAIMS = f"""claims AS (
    SELECT 'Q' || l_orderkey AS entity_id, ['P31', 'P361', 'P0', 'P1128', 'P571'][1 + l_linenumber % 5] AS property_id, {_ORD} AS ord,
        CASE WHEN l_linenumber % 5 < 3 THEN 'wikibase-entityid' WHEN l_linenumber % 5 = 3 THEN 'quantity' ELSE 'time' END AS value_type,
        CASE WHEN l_linenumber % 5 < 3 THEN 'Q' || l_partkey % 7 END AS target_id, CASE WHEN l_linenumber % 5 >= 3 THEN '+' || l_partkey END AS value
    FROM lineitem
)"""


def _claims(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("Q"), F.col("l_orderkey").cast("string")).alias("entity_id"),
        F.get(F.array(*map(F.lit, ["P31", "P361", "P0", "P1128", "P571"])), n).alias("property_id"),
        F.expr(_ORD).alias("ord"),
        F.when(n < 3, "wikibase-entityid").when(n == 3, "quantity").otherwise("time").alias("value_type"),
        F.when(n < 3, F.concat(F.lit("Q"), (F.col("l_partkey") % 7).cast("string"))).alias("target_id"),
        F.when(n >= 3, F.concat(F.lit("+"), F.col("l_partkey").cast("string"))).alias("value"),
    )


@query(f"""
WITH {_CLAIMS}, found AS (
    SELECT entity_id AS src, target_id AS dst, count(*) AS frequency, arg_min(CASE property_id WHEN 'P31' THEN 'instance_of' ELSE 'part_of' END, ord) AS relation, min(ord) AS ord
    FROM claims WHERE property_id IN ('P31', 'P361') GROUP BY 1, 2
)
SELECT src, dst, frequency, relation FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS n FROM found) WHERE n <= 2
""")
def claim_expansion(spark, sf_dir):
    return graph.claim_neighbours(_claims(spark, sf_dir), graph.relation_dim(spark), 2).select("src", "dst", "frequency", "relation")


@query("SELECT l_orderkey, l_linenumber, coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS supplier FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON l_suppkey = s_suppkey")
def label_substitution(spark, sf_dir):
    labels = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("label"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("supplier"))
    return graph.label_ids(rows, "supplier", labels)


@query(f"""
WITH {_CLAIMS}, named AS (
    SELECT entity_id, ord, CASE property_id WHEN 'P31' THEN 'instance_of' WHEN 'P1128' THEN 'employees' ELSE 'inception' END AS name, CASE property_id WHEN 'P31' THEN 3 ELSE 1 END AS most,
        CASE WHEN target_id IN ('Q1', 'Q3', 'Q5') THEN 'label ' || target_id ELSE coalesce(target_id, value) END AS shown
    FROM claims WHERE property_id IN ('P31', 'P1128', 'P571')
), first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, name ORDER BY ord) AS n FROM named) WHERE n <= most),
listed AS (SELECT entity_id, name, string_agg(shown, ',' ORDER BY ord) AS shown FROM first GROUP BY 1, 2)
SELECT entity_id, string_agg(name || '=' || shown, ';' ORDER BY name) AS properties FROM listed GROUP BY entity_id
HAVING count(*) + CASE WHEN CAST(substr(entity_id, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END > 1
""")
def node_properties(spark, sf_dir):
    labels = spark.createDataFrame([(q, f"label {q}") for q in ("Q1", "Q3", "Q5")], "id string, label string")
    claims = _claims(spark, sf_dir)
    own = F.when(F.substr("entity_id", F.lit(2)).cast("long") % 2 == 0, F.col("entity_id")).otherwise("")
    nodes = claims.select("entity_id").distinct().select("entity_id", own.alias("label"), F.lit(None).cast("string").alias("description"))
    found = synthesis.with_properties(nodes, synthesis.entity_properties(claims, labels)).where("properties IS NOT NULL")
    shown = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return found.select("entity_id", shown.alias("properties"))


@query(f"WITH {_CLAIMS} SELECT entity_id, string_agg(DISTINCT target_id, ',' ORDER BY target_id) FILTER (WHERE target_id IS NOT NULL) AS ids FROM claims GROUP BY entity_id")
def claimed_ids(spark, sf_dir):
    listed = _claims(spark, sf_dir).groupBy("entity_id").agg(F.collect_list(F.struct("value_type", "target_id")).alias("claims"))
    return listed.select("entity_id", F.nullif(F.array_join(R.claim_ids(F.col("claims")), ","), F.lit("")).alias("ids"))


# ---- attributes carried along


def _edges(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.expr(_ORD).alias("ord"), F.col("l_suppkey").cast("string").alias("entity"), F.col("l_quantity").alias("q"))


@query(f"""
WITH c AS (SELECT CAST(s_suppkey AS VARCHAR) AS entity, CASE WHEN s_suppkey % 4 = 0 THEN 'ABSTRACT' ELSE 'ORG' END AS entity_type, s_acctbal AS confidence FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT l_orderkey AS src, {_ORD} AS ord, CAST(l_suppkey AS VARCHAR) AS entity, coalesce(entity_type, 'OTHER') AS entity_type, coalesce(confidence, 0.5) AS confidence
FROM lineitem LEFT JOIN c ON c.entity = CAST(l_suppkey AS VARCHAR) WHERE coalesce(entity_type, 'OTHER') <> 'ABSTRACT'
""")
def concrete_neighbours(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0")
    # the second row of an entity never counts
    classes = rows.select(F.col("s_suppkey").cast("string").alias("entity"), F.lit(0).alias("ord"), F.when(F.col("s_suppkey") % 4 == 0, "ABSTRACT").otherwise("ORG").alias("entity_type"), F.col("s_acctbal").alias("confidence"))
    classes = classes.unionByName(classes.withColumns({"ord": F.lit(1), "entity_type": F.lit("PER")}))
    return synthesis.concrete(synthesis.classified(_edges(spark, sf_dir).drop("q"), classes))


@query(f"""
SELECT l_orderkey AS src, {_ORD} AS ord, round(coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 10 / 10.0 END, 0.5), 6) AS familiarity FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
""")
def edge_familiarity(spark, sf_dir):
    scores = read(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("string").alias("entity"), F.lit(0).alias("ord"), (F.col("s_suppkey") % 10 / 10).alias("familiarity"))
    edges = _edges(spark, sf_dir).withColumnRenamed("entity", "dst")
    return synthesis.with_familiarity(edges, scores).select("src", "ord", F.round("familiarity", 6).alias("familiarity"))


@query(f"""
SELECT src, ord FROM (SELECT l_orderkey AS src, {_ORD} AS ord, l_quantity / 50 AS f, count(*) FILTER (WHERE l_quantity / 50 < 0.4) OVER (PARTITION BY l_orderkey) AS low FROM lineitem) WHERE f < 0.4 OR low = 0
""")
def unfamiliar_edges(spark, sf_dir):
    return graph.unfamiliar(_edges(spark, sf_dir).withColumn("familiarity", F.col("q") / 50)).select("src", "ord")


@query(f"""
SELECT src, ord FROM (SELECT l_orderkey AS src, {_ORD} AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity / 50, {_ORD}) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE rank <= greatest(2, least(3, n))
""")
def edge_fan_out(spark, sf_dir):
    ranked = graph.rank_edges(_edges(spark, sf_dir).withColumns({"familiarity": F.col("q") / 50, "confidence": F.lit(1.0)}))
    return synthesis.fan_out(ranked, 2).select("src", "ord")


@query(f"""
WITH c AS (SELECT l_orderkey AS src, {_ORD} AS ord, CASE l_linenumber % 3 WHEN 0 THEN 'Part_' ELSE 'part  ' END || l_partkey % 50 AS entity, 'part ' || l_partkey % 50 AS norm, l_partkey % 50 AS k FROM lineitem),
fresh AS (SELECT src, arg_min(entity, ord) AS entity, min(ord) AS ord FROM c WHERE k % 5 <> 0 OR src % 2 = 0 GROUP BY src, norm),
kept AS (SELECT * FROM fresh WHERE entity NOT IN ('part  7', 'Part_8'))
SELECT src, ord, entity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord) AS n FROM kept) WHERE n <= 3
""")
def neighbour_collection(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    name = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "Part_").otherwise("part  "), (F.col("l_partkey") % 50).cast("string"))
    rows = lines.select(F.col("l_orderkey").cast("string").alias("src"), F.expr(_ORD).alias("ord"), name.alias("entity"), (F.col("l_partkey") % 50).alias("k"))
    visited = rows.where("cast(src AS bigint) % 2 = 1 AND k % 5 = 0").select("src", F.upper("entity").alias("entity"))
    classes = spark.createDataFrame([("part  7", 0, "ABSTRACT", 0.9), ("Part_8", 0, "ABSTRACT", 0.9)], "entity string, ord int, entity_type string, confidence double")
    found = synthesis.collect_neighbours(rows.drop("k"), visited, classes, 3)
    return found.select(F.col("src").cast("long").alias("src"), "ord", "entity")


#: A graph over nations: each has edges to the next ones.
_NATION_EDGES = """e AS (
    SELECT a.n_nationkey AS src, (a.n_nationkey * 7 + k * 5 + 1) % 25 AS dst, 'r' || k AS relation, 0.9 + k / 100.0 AS confidence, k * (a.n_nationkey % 3) AS frequency FROM nation a, range(0, 4) t(k)
)"""


@query(f"""
WITH RECURSIVE {_NATION_EDGES}, o AS (SELECT *, CASE WHEN frequency = 0 THEN 999 ELSE frequency END AS rare FROM e),
walk(seed, nodes, last, hops) AS (
    SELECT n_nationkey, [n_nationkey], n_nationkey, 0 FROM nation
    UNION ALL
    SELECT seed, list_append(nodes, dst), dst, hops + 1 FROM (
        SELECT w.*, o.dst, row_number() OVER (PARTITION BY w.seed, w.hops ORDER BY o.rare, -o.confidence, o.dst) AS n FROM walk w JOIN o ON o.src = w.last WHERE NOT list_contains(w.nodes, o.dst) AND w.hops < 3
    ) WHERE n = 1
)
SELECT seed, array_to_string(arg_max(nodes, hops), '>') AS path FROM walk GROUP BY seed
""")
def chain_extension(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    k = nations.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    edges = k.select("src", ((F.col("src") * 7 + F.col("k") * 5 + 1) % 25).alias("dst"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("relation"), (F.col("k") / 100 + 0.9).alias("confidence"), (F.col("k") * (F.col("src") % 3)).alias("frequency"))
    chains = nations.select(F.col("src").alias("seed"), F.array("src").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    done = synthesis.re_extend(chains, edges, 3)
    return done.select(F.col("seed").cast("int").alias("seed"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("path"))


@query("""
WITH c AS (SELECT source AS entity, lang, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents WHERE lang IN ('fr', 'de'))
SELECT entity, arg_min(lang, CASE lang WHEN 'fr' THEN 0 ELSE 1 END) AS language FROM c WHERE n = 1 AND coalesce(text, '') <> '' GROUP BY entity
""")
def context_fallback(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("lang IN ('fr', 'de')")
    first = graph.top(docs, ["source", "lang"], [F.col("doc_id")], 1)
    nothing = F.array().cast("array<string>")
    contexts = first.select(F.col("source").alias("entity"), F.col("lang").alias("language"), F.col("text").alias("extract"), nothing.alias("links"), nothing.alias("categories"))
    return synthesis.context_of(contexts, ("fr", "de")).select("entity", "language")


@query("""
WITH h AS (SELECT source AS query, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS ord, 'Q' || doc_id % 40 AS id FROM documents WHERE lang IN ('en', 'fr')),
f AS (SELECT query, id, min(struct_pack(l := CASE lang WHEN 'en' THEN 1 ELSE 2 END, o := ord)) AS best FROM h WHERE ord < 5 GROUP BY query, id)
SELECT query, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY best) AS n FROM f) WHERE n <= 10
""")
def merged_languages(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")) - 1
    hits = read(spark, sf_dir, "documents").select(F.col("source").alias("query"), F.col("lang").alias("language"), place.alias("ord"), F.concat(F.lit("Q"), (F.col("doc_id") % 40).cast("string")).alias("id"))
    return synthesis.merge_languages(hits, ("en", "fr")).select("query", "id")


@query("""
WITH e AS (SELECT n_name AS name, 'flag of ' || n_regionkey AS description FROM nation WHERE n_nationkey % 2 = 0)
SELECT c_custkey, n_name AS root, description FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN e ON e.name = n_name WHERE c_custkey % 4 <> 0
""")
def visual_descriptions(spark, sf_dir):
    nations = read(spark, sf_dir, "nation")
    asked = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("n_name")).alias("root"))
    entities = nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit(0).alias("ord"), F.concat(F.lit("flag of "), F.col("n_regionkey").cast("string")).alias("description"))
    return synthesis.with_description(asked, entities)


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def known_target_questions(spark, sf_dir):
    known = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name"))
    return synthesis.known_targets(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("target_entity")), known).select("o_orderkey")


@query("""
WITH o AS (SELECT text AS question, arg_min(source, doc_id) AS path FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL GROUP BY text)
SELECT doc_id, path FROM documents d LEFT JOIN o ON o.question = d.text
""")
def reasoning_paths(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    originals = docs.where("doc_id % 2 = 0 AND text IS NOT NULL").select(F.col("text").alias("question"), F.col("doc_id").alias("ord"), F.array("source").alias("reasoning_path"))
    return synthesis.with_reasoning_path(docs.select("doc_id", F.col("text").alias("original_question")), originals).select("doc_id", F.array_join("reasoning_path", ",").alias("path"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND length(trim(p_type)) >= 11 THEN p_type ELSE p_name END AS question FROM part
""")
def simplified_questions(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    short = parts.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("question"))
    return synthesis.simplified(parts.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("question")), short).select(F.col("ord").alias("p_partkey"), "question")


@query(f"""
WITH f AS (SELECT l_orderkey, l_suppkey % 10 AS target, arg_min(l_returnflag, {_ORD}) AS relation_type FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, t AS entity, relation_type FROM orders CROSS JOIN range(0, 3) r(t) LEFT JOIN f ON f.l_orderkey = o_orderkey AND f.target = t
""")
def edge_into_node(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chain_id"), F.expr(_ORD).alias("ord"), (F.col("l_suppkey") % 10).alias("target"), F.col("l_returnflag").alias("relation_type"), F.lit("").alias("evidence"))
    nodes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("entity"))
    return synthesis.edge_into(nodes, edges).select(F.col("chain_id").alias("o_orderkey"), "entity", "relation_type")


@query("SELECT c_custkey AS ord, c_name, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def zipped_rows(spark, sf_dir):
    left = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), "c_name")
    return synthesis.side_by_side(left, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), "s_name"))


@query("SELECT doc_id AS original_index FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE lang = 'fr'")
def dropped_indices(spark, sf_dir):
    index = F.col("doc_id").alias("original_index")
    return synthesis.indices_union(read(spark, sf_dir, "labels").where("toxic = 1").select(index), read(spark, sf_dir, "documents").where("lang = 'fr'").select(index))


# ---- reports


@query("SELECT CAST(sum(n) AS BIGINT) AS total, round(sum(n) / 7.0, 6) AS samples_per_second, round(7.0 / sum(n), 9) AS seconds_per_sample FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def throughput(spark, sf_dir):
    stats = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"))
    return synthesis.run_totals(stats, 7.0).withColumns({"samples_per_second": F.round("samples_per_second", 6), "seconds_per_sample": F.round("seconds_per_sample", 9)})


@query("SELECT round(avg(coalesce(quality, 0)), 6) AS mean_difficulty_score, round(avg(coalesce(toxic, 0)), 6) AS mean_uniqueness_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def mean_question_scores(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("difficulty_score"), F.col("toxic").cast("double").alias("uniqueness_score"))
    means = synthesis.mean_scores(read(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left"))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query("SELECT 'entities' AS stage, count(*) AS n FROM part UNION ALL SELECT 'questions', count(*) FROM orders UNION ALL SELECT 'vqa_items', count(*) FROM pages")
def stage_sizes(spark, sf_dir):
    return synthesis.stage_counts({"entities": read(spark, sf_dir, "part"), "questions": read(spark, sf_dir, "orders"), "vqa_items": read(spark, sf_dir, "pages")})


@query("""
WITH r AS (SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'rewrite' WHEN quality = 0 AND doc_id % 2 = 0 THEN 'keep_model_issue' WHEN quality = 0 THEN 'rewrite' ELSE 'keep' END AS route FROM labels)
SELECT route, count(*) AS n FROM r GROUP BY route
""")
def route_sizes(spark, sf_dir):
    route = P.leak_route(F.col("quality") == 1, F.col("toxic") == 1, F.col("doc_id") % 2 == 0)
    return synthesis.route_counts(read(spark, sf_dir, "labels").select(route.alias("route")))


@query("""
WITH RECURSIVE q AS (SELECT event_id, user_id % 20 AS api_key, CAST(date_diff('second', TIMESTAMP '2020-01-01', ts) // 60 AS DOUBLE) AS asked FROM events WHERE user_id % 20 < 4),
k AS (SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY asked, event_id) AS n FROM q)
SELECT event_id, max(asked - n * 3.0) OVER (PARTITION BY api_key ORDER BY n) + n * 3.0 AS starts FROM k
""")
def request_spacing(spark, sf_dir):
    asked = F.floor(F.timestamp_diff("SECOND", F.lit("2020-01-01").cast("timestamp_ntz"), F.col("ts")) / 60).cast("double")
    rows = read(spark, sf_dir, "events").where("user_id % 20 < 4").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 20).alias("api_key"), asked.alias("asked"))
    return synthesis.throttled(rows, 20).select(F.col("request_id").alias("event_id"), "starts")


@query("SELECT l_orderkey AS sample_id, max(l_discount) AS score FROM lineitem GROUP BY l_orderkey")
def best_gold_score(spark, sf_dir):
    return scoring.best_over_golds(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("gold"), F.col("l_discount").alias("score")))


# ---- model responses


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ORG' ELSE 'OTHER' END AS entity_type, CAST(CASE doc_id % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 END AS DOUBLE) AS confidence FROM documents WHERE doc_id % 3 <> 2
""")
def response_classes(spark, sf_dir):
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('```json\n[{"entity": "e'), F.col("doc_id").cast("string"), F.lit('", "entity_type": "ORG", "confidence": 0.75}, {"entity": ""}]\n```'))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit('[{"entity": "e'), F.col("doc_id").cast("string"), F.lit('", "entity_type": "what"}]'))
    ).otherwise("no json")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(R.classifications(body)).alias("c"))
    return rows.select("doc_id", "c.entity_type", "c.confidence")


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'part_of' ELSE 'none' END AS relation_type, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.95 ELSE 0.0 END AS DOUBLE) AS confidence,
    CASE WHEN doc_id % 2 = 0 THEN 'said ' || source WHEN source = '' THEN '' ELSE source END AS evidence FROM documents
""")
def response_verdicts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    even = F.concat(F.lit('[{"index": 1, "relation_type": "part_of", "confidence": 0.95, "evidence": "said '), "source", F.lit('"}, {"index": 9}, {"index": 0}]'))
    rows = docs.select("doc_id", "source", F.explode(R.verdicts(F.when(F.col("doc_id") % 2 == 0, even).otherwise('[{"index": 2}, {"index": "x"}]'), F.lit(3))).alias("v"))
    return rows.select("doc_id", "v.relation_type", "v.confidence", R.joined_evidence(F.col("v.evidence"), F.col("source")).alias("evidence"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'c,a' WHEN 1 THEN 'a,b' ELSE 'a,b' END AS picked FROM documents
""")
def response_picks(spark, sf_dir):
    body = F.when(F.col("doc_id") % 3 == 0, '```\n{"indices": [3, 3, 9, "x", 1, 2]}\n```').when(F.col("doc_id") % 3 == 1, '{"indices": []}').otherwise("none")
    names = F.array(*map(F.lit, "abc"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(R.picked(names, body, 2), ",").alias("picked"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS score FROM documents")
def response_familiarity(spark, sf_dir):
    body = F.when(F.col("doc_id") % 2 == 0, '{"familiarity_scores": [{"entity": "a", "score": 0.9}, {"entity": "a", "score": 0.25}, {"entity": ""}]}').otherwise('{"familiarity_scores": [{"entity": "a"}]}')
    return read(spark, sf_dir, "documents").select("doc_id", F.try_element_at(R.familiarity(body), F.lit("a")).alias("score"))


@query("""
SELECT doc_id, 'Wikidata P361 (part_of) links ' || lang || ' to ' || source || '.' || CASE WHEN doc_id % 2 = 0 THEN ' Wikipedia sentence: It is in ' || source || '!' ELSE '' END AS evidence, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS sources FROM documents
""")
def edge_evidence(spark, sf_dir):
    extract = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("First one. It is in "), "source", F.lit("! Last."))).otherwise("Nothing here.")
    built = R.wikidata_evidence(F.col("lang"), F.col("source"), F.lit("part_of"), F.lit("P361"), F.lit("Q1"), extract, F.lit("http://x"))
    return read(spark, sf_dir, "documents").select("doc_id", built.alias("b")).select("doc_id", F.col("b.text").alias("evidence"), F.size("b.sources").alias("sources"))


@query("""
SELECT doc_id, '{"a": {"b": ' || doc_id || '}}' AS sliced, CAST(doc_id AS VARCHAR) AS field, 'unknown' AS missing, CASE WHEN doc_id % 2 = 0 THEN 'DIVIDE' END AS operation, 2 AS objects, 'in ' || lang AS inner_text FROM documents
""")
def broken_json(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    fence = F.concat(F.lit('so ```json\n{"a": {"b": '), number, F.lit("}} and {more}\n```"))
    cut = F.concat(F.lit('{"score": '), number, F.lit(', "title": "unfinis'))
    plan = F.when(F.col("doc_id") % 2 == 0, "x **Operation**: divide").otherwise("Operation: SQUARE")
    many = T.json_objects(F.concat(F.lit('"solves": [{"a": 1}, {broken}, {"a": '), number, F.lit("}, {")), "a int")
    return read(spark, sf_dir, "documents").select(
        "doc_id", T.json_slice(fence).alias("sliced"), T.json_field(cut, "score").alias("field"), T.json_field(cut, "nothing").alias("missing"), T.fusion_operation(plan).alias("operation"), F.size(many).alias("objects"), T.fenced(F.concat(F.lit("```txt\nin "), "lang", F.lit("\n```"))).alias("inner_text")
    )


@query("""
SELECT doc_id, 0 AS original_index, 'correct' AS solve_result, doc_id % 2 = 0 AS leakage_detected, 'none' AS leakage_type, 'because ' || lang AS leakage_reason FROM documents
UNION ALL SELECT doc_id, 1, 'incorrect', false, 'direct', '' FROM documents
""")
def judge_markdown(spark, sf_dir):
    text = F.concat(
        F.lit("intro\n### original_index=0, solve_result=correct\n- leakage_detected: "), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit("\n- leakage_reason: because "), "lang",
        F.lit("\n### original_index=1, solve_result=incorrect\n- leakage_type: direct\n- leakage_detected: maybe\n"),
    )
    report = quality.judge_report(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return report.select("doc_id", "original_index", "solve_result", "leakage_detected", "leakage_type", "leakage_reason")


# ---- rules


@query(f"""
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'List of ' || lang WHEN 1 THEN '1984' WHEN 2 THEN '19th century' WHEN 3 THEN source || ' in 1990' WHEN 4 THEN 'Template:' || source ELSE source END AS link,
    CASE doc_id % 5 WHEN 0 THEN 'Articles with ' || lang WHEN 1 THEN '1990s ' || lang WHEN 2 THEN 'Use dmy' WHEN 3 THEN '1950 births' ELSE source END AS category FROM documents)
SELECT doc_id, doc_id % 6 <> 5 OR regexp_matches(lower(link), '^(?:{'|'.join(P.LINK_PREFIXES)})|{'|'.join(P.LINK_PARTS)}') AS link, doc_id % 5 <> 4 OR regexp_matches(lower(category), '^(?:{'|'.join(P.CATEGORY_PREFIXES)})|{'|'.join(P.CATEGORY_PARTS)}') AS category FROM t
""")
def noisy_titles(spark, sf_dir):
    n, m = F.col("doc_id") % 6, F.col("doc_id") % 5
    link = F.when(n == 0, F.concat(F.lit("List of "), "lang")).when(n == 1, "1984").when(n == 2, "19th century").when(n == 3, F.concat("source", F.lit(" in 1990"))).when(n == 4, F.concat(F.lit("Template:"), "source")).otherwise(F.col("source"))
    category = F.when(m == 0, F.concat(F.lit("Articles with "), "lang")).when(m == 1, F.concat(F.lit("1990s "), "lang")).when(m == 2, "Use dmy").when(m == 3, "1950 births").otherwise(F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", P.noisy_link(link).alias("link"), P.noisy_category(category).alias("category"))


@query("""
SELECT source AS src, 'linked' AS relation, 'link ' || source AS entity FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT source, 'category', 'kind of ' || source FROM (SELECT DISTINCT source FROM documents)
""")
def wiki_neighbours(spark, sf_dir):
    names = read(spark, sf_dir, "documents").select(F.col("source").alias("src")).distinct()
    links = F.array(F.lit("List of x"), F.upper("src"), F.concat(F.lit("link "), "src"), F.lit("1999"))
    return graph.wiki_candidates(names.select("src", links.alias("links"), F.array(F.lit("All articles"), F.concat(F.lit("kind of "), "src")).alias("categories"))).select("src", "relation", "entity")


@query("""
SELECT p_partkey, CAST(greatest(0, 5 - p_size) + CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 4 ELSE 0 END + 1 + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END - CASE WHEN p_partkey % 7 = 0 THEN 20 ELSE 0 END - CASE WHEN p_partkey % 11 = 0 THEN 8 ELSE 0 END AS INT) AS score FROM part
""")
def hit_score(spark, sf_dir):
    k = F.col("p_partkey")
    labels = F.array(F.when(k % 3 == 0, "eiffel tower").when(k % 3 == 1, "the eiffel tower").otherwise("other"))
    links = F.create_map(F.lit("enwiki"), F.when(k % 2 == 0, "Eiffel").otherwise(""))
    instances = F.array(F.when(k % 7 == 0, "Q4167410").otherwise("Q5"))
    score = N.candidate_score(F.col("p_size"), F.lit("eiffel tower"), labels, F.when(k % 11 == 0, "Wikimedia category").otherwise("a tower"), links, instances)
    return read(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query("""
SELECT p_partkey, CAST(ceil(p_size / 28.0) * 28 AS BIGINT) AS up, CAST(floor(p_size / 28.0) * 28 AS BIGINT) AS down, round(0.4 * 0.5 + 0.3 + 0.2 * (p_size / 50.0) + 0.1 * 0.9, 6) AS priority,
    round(CASE WHEN p_size % 2 = 0 THEN 0 ELSE 300.0 / p_size END, 6) AS rate, CAST(least(pow(2, p_size % 8), 32) AS DOUBLE) AS wait, CAST(4 + pow(2, least(p_size % 8, 6)) AS DOUBLE) AS limit_wait FROM part
""")
def number_rules(spark, sf_dir):
    size, n = F.col("p_size"), (F.col("p_size") % 8).cast("double")
    return read(spark, sf_dir, "part").select(
        "p_partkey", N.ceil_to(size, 28).alias("up"), N.floor_to(size, 28).alias("down"), F.round(N.expansion_priority(F.lit(0.5), size / 50, F.lit(0.9)), 6).alias("priority"),
        F.round(N.rate(F.lit(3), F.when(size % 2 == 0, 0).otherwise(size)), 6).alias("rate"), N.BACKOFFS["model"](n).cast("double").alias("wait"), N.BACKOFFS["limit"](n).cast("double").alias("limit_wait"),
    )


@query("""
WITH s AS (SELECT p_partkey, p_size * 100 AS h, p_size * 170 AS w FROM part), f AS (SELECT *, least(1.0, sqrt(1000000 / (h * w))) AS a, least(1.0, 4096 / w, 4096 / h) AS b FROM s)
SELECT p_partkey, CAST(trunc(h * a) AS BIGINT) AS area_h, CAST(trunc(w * a) AS BIGINT) AS area_w, CAST(trunc(h * b) AS BIGINT) AS fit_h, CAST(trunc(w * b) AS BIGINT) AS fit_w FROM f
""")
def image_limits(spark, sf_dir):
    h, w = F.col("p_size") * 100, F.col("p_size") * 170
    rows = read(spark, sf_dir, "part").select("p_partkey", N.limit_area(h, w, 1_000_000).alias("a"), N.fit_inside(h, w).alias("f"))
    return rows.select("p_partkey", F.col("a.height").alias("area_h"), F.col("a.width").alias("area_w"), F.col("f.height").alias("fit_h"), F.col("f.width").alias("fit_w"))


@query("""
SELECT page_id, page_id % 2 = 0 AND page_id % 3 <> 0 AND NOT contains(lower(url), 'thumb') AND NOT contains(lower(url), 'preview') AS image, page_id % 5 < 4 AND page_id % 4 <> 1 AS page, length(trim(url)) >= 30 AS long FROM pages
""")
def page_rules(spark, sf_dir):
    k = F.col("page_id")
    image = P.good_image(F.col("url"), F.when(k % 2 == 0, 400).otherwise(399), F.when(k % 3 != 0, 500).otherwise(100))
    page = P.readable_page(F.when(k % 5 < 4, 200).otherwise(404), F.when(k % 4 == 1, "image/png").otherwise("Text/HTML; charset=utf-8"))
    return read(spark, sf_dir, "pages").select("page_id", image.alias("image"), page.alias("page"), P.long_enough(F.col("url"), 30).alias("long"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS valid FROM part
""")
def entity_names(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "1984").when(k == 1, "string theory").when(k == 2, "Eiffel Tower").when(k == 3, "塔").otherwise("Newton theory of light")
    return read(spark, sf_dir, "part").select("p_partkey", P.valid_entity(name).alias("valid"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '!' WHEN 1 THEN source ELSE 'any' END AS picked, CASE WHEN doc_id % 2 = 0 THEN 'Where is that tower?' ELSE 'that tower, who is it?' END AS referred, 'synthesis_' || source || '_20240101_' || doc_id AS question_id,
    'Too [IMAGE]"' AS redacted, doc_id % 2 = 0 AS limited, md5('a_' || lang) AS file, 'image/' || CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpeg' END AS mime FROM documents
""")
def text_rules(spark, sf_dir):
    k = F.col("doc_id")
    values = F.create_map(F.lit("en"), F.when(k % 3 == 0, F.concat("lang", F.lit("!"))).otherwise(""), F.lit("zh"), F.when(k % 3 == 1, F.col("source")).otherwise(""), F.lit("xx"), F.lit("any"))
    question = F.when(k % 2 == 0, "Where is EIFFEL TOWER?").otherwise("Who is it?")
    return read(spark, sf_dir, "documents").select(
        "doc_id", T.pick_language(values, ["en", "zh"]).alias("picked"), T.refer_visually(question, F.lit("Eiffel Tower"), F.lit("that tower")).alias("referred"), T.question_id(F.col("source"), F.lit("20240101"), k).alias("question_id"),
        T.redact(F.lit('Too data:image/png;base64,AAAA"')).alias("redacted"), T.rate_limited(F.when(k % 2 == 0, "HTTP 429: slow down").otherwise("no")).alias("limited"), T.file_key(F.concat(F.lit("a "), "lang")).alias("file"),
        T.image_mime(F.when(k % 2 == 0, "x.PNG").otherwise("x.bmp")).alias("mime"),
    )


@query("""
SELECT source, 'Query: ' || source || chr(10) || chr(10) || string_agg(n || '. ' || lang || chr(10) || doc_id || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE 'No link' END, chr(10) || chr(10) ORDER BY n) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY source
""")
def search_contexts(spark, sf_dir):
    link = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), F.col("doc_id").cast("string")))
    first = graph.top(read(spark, sf_dir, "documents"), ["source"], [F.col("doc_id")], 3)
    hits = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.col("lang").alias("title"), F.col("doc_id").cast("string").alias("snippet"), link.alias("link")))).alias("hits"))
    return hits.select("source", T.search_context(F.col("source"), F.col("hits")).alias("context"))


@query("""
SELECT page_id, '<span class="tag answer">&lt;answer&gt;</span>' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '<br>&lt;b&gt;' AS shown, 'x' || url AS bare FROM pages
""")
def viewer_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.highlight(F.concat(F.lit("<answer>"), "url", F.lit("\n<b>"))).alias("shown"), T.strip_tags(F.concat(F.lit("<i>x</i>"), "url")).alias("bare"))


# ---- stores, picks, exports


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'sum ' || event_type ELSE event_type END AS summary, event_type || ',b' AS listed FROM events WHERE CAST(date_diff('second', TIMESTAMP '1970-01-01', ts) AS BIGINT) > 0
""")
def cached_values(spark, sf_dir):
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"summaries": "sum '), "event_type", F.lit('"}'))).otherwise(F.col("event_type"))
    rows = keyed.fresh(read(spark, sf_dir, "events").withColumn("cached_at", F.unix_seconds(F.col("ts").cast("timestamp"))), "cached_at", 1e10)
    listed = keyed.cached_list(F.concat(F.lit('["'), "event_type", F.lit('", "b", "c"]')), "array<string>", 2)
    return rows.select("event_id", keyed.unwrap_summary(value).alias("summary"), F.array_join(listed, ",").alias("listed"))


@query("SELECT lang AS query, source, doc_id FROM documents d WHERE source = (SELECT min(source) FROM documents e WHERE e.lang = d.lang AND source IN ('none', 'src1', 'src2'))")
def first_source_rows(spark, sf_dir):
    return merge.first_source(read(spark, sf_dir, "documents").select(F.col("lang").alias("query"), "source", "doc_id"), ["none", "src1", "src2"])


@query("SELECT o_orderkey AS id, r AS rank, i AS \"index\", 'v' || (i + o_orderkey) AS value FROM orders, (VALUES (0, 3), (2, 1)) p(r, i)")
def positional_picks(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("v"), (F.col("o_orderkey") + i).cast("string"))).alias("c"))
    picks = rows.select("id", F.array(F.lit(3), F.lit(9), F.lit(1), F.lit(0)).alias("picks"))
    return quality.positional(rows, picks, "c", "picks")


@query("""
SELECT n_nationkey, 'a>r1>b;b>r2>' || n_name AS edges, 'a,m' AS merged FROM nation
""")
def path_rules(spark, sf_dir):
    nodes = F.array(F.lit("a"), F.lit("b"), F.col("n_name"))
    edges = graph.path_edges(nodes, F.array(F.lit("r1"), F.lit("r2")))
    shown = F.array_join(F.transform(edges, lambda e: F.concat_ws(">", e["source"], e["relation"], e["target"])), ";")
    merged = graph.merge_nodes(nodes, F.array(F.col("n_name"), F.lit("b")), F.lit("m"))
    return read(spark, sf_dir, "nation").select("n_nationkey", shown.alias("edges"), F.array_join(merged, ",").alias("merged"))


@query("""
SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 3 = 0 THEN 'local.png' WHEN page_id % 3 = 1 THEN url ELSE '' END AS image FROM pages
""")
def visual_training_export(spark, sf_dir):
    k = F.col("page_id")
    text = ["question", "answer", "original_question", "original_answer", "target_entity", "visual_reference", "entity_type", "difficulty", "domain"]
    items = read(spark, sf_dir, "pages").select(
        k.cast("string").alias("id"), *[F.lit("").alias(c) for c in text], F.array().cast("array<string>").alias("reasoning_path"), F.when(k % 3 == 0, "local.png").otherwise("").alias("local_image_path"), F.when(k % 3 == 2, "data:image/png").otherwise(F.col("url")).alias("image_url")
    )
    return sinks.visual_export(items).select("id", "image")


@query("SELECT event_id, 'ask ' || event_type AS request, 'x [IMAGE]\"' AS error FROM events")
def redacted_calls(spark, sf_dir):
    return sinks.call_log(read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("ask "), "event_type").alias("request"), F.lit('x data:image/gif,AA"').alias("error")))


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS n FROM pages WHERE NOT regexp_matches(lower(url), '\\.(?:" + "|".join(P.SKIPPED_EXTENSIONS) + ")$')) WHERE n <= 3")
def fetched_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    first = graph.top(pages.where(~P.skipped_url(F.col("url"))), [F.expr("page_id % 10")], [F.col("page_id")], 3)
    return pages.join(first.select("page_id"), "page_id")


@query("SELECT n_name AS name, 'd' || n_regionkey AS description FROM nation WHERE n_regionkey > 0")
def described_stage_entities(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("d"), F.col("n_regionkey").cast("string"))).alias("description"))
    return config.described_entities(rows)

