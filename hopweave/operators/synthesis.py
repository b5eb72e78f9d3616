"""Attributes carried along the synthesis stages: properties, classes, familiarity, references; re-extension; reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions import numeric as N
from hopweave.functions import predicates as P
from hopweave.functions import text as T
from hopweave.operators import graph
from hopweave.operators.merge import first_wins

# Property id, name in the result, type of value, values kept, of the properties of an entity.
PROPERTIES = [
    ("P31", "instance_of", "wikibase-entityid", 3),
    ("P569", "date_of_birth", "time", 1),
    ("P570", "date_of_death", "time", 1),
    ("P19", "place_of_birth", "wikibase-entityid", 1),
    ("P27", "country_of_citizenship", "wikibase-entityid", 1),
    ("P276", "location", "wikibase-entityid", 1),
    ("P281", "postal_code", "string", 1),
    ("P37", "official_language", "wikibase-entityid", 1),
    ("P1705", "language_of_work", "wikibase-entityid", 1),
    ("P571", "inception", "time", 1),
    ("P159", "headquarters", "wikibase-entityid", 1),
    ("P1128", "employees", "quantity", 1),
    ("P2132", "revenue", "quantity", 1),
]


def entity_properties(claims: DataFrame, labels: DataFrame, properties: list[tuple[str, str, str, int]] = PROPERTIES) -> DataFrame:
    """(entity_id, properties): per entity a map name -> values, ids replaced by labels (id, label) where known.

    ``claims``: (entity_id, property_id, ord, value_type, target_id, value); the
    first claims of the type that a property asks for count.
    """
    dim = claims.sparkSession.createDataFrame(properties, "property_id string, name string, value_type string, most int")
    known = claims.join(F.broadcast(dim), ["property_id", "value_type"])
    found = known.select("entity_id", "name", "ord", "most", F.when(F.col("value_type") == "wikibase-entityid", F.col("target_id")).otherwise(F.col("value")).alias("value"), (F.col("value_type") == "wikibase-entityid").alias("is_id"))
    first = graph.top(found, ["entity_id", "name"], [F.col("ord")], F.col("most"))
    ids = labels.select(F.col("id").alias("value"), F.lit(True).alias("is_id"), "label")
    named = first.join(ids, ["value", "is_id"], "left").withColumn("shown", F.coalesce("label", "value"))
    listed = named.groupBy("entity_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "shown"))), lambda x: x["shown"]).alias("values"))
    return listed.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("properties"))


def with_properties(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Nodes (entity_id, label, description, ...) with their property map; nodes of at most one entry are left out."""
    own = nodes.join(properties, "entity_id", "left")
    size = F.coalesce(F.size("properties"), F.lit(0)) + sum((F.coalesce(F.col(c), F.lit("")) != "").cast("int") for c in ("label", "description"))
    return own.where(size > 1)


def attach(rows: DataFrame, column: str, attributes: DataFrame, key: str, order: str, defaults: dict[str, object]) -> DataFrame:
    """Rows with the attributes of the first row of ``attributes`` whose ``key`` equals ``column``, else the defaults."""
    first = first_wins(attributes, F.col(key), order).select(F.col(key).alias("__key"), *defaults)
    out = rows.join(first, F.col(column) == F.col("__key"), "left").drop("__key")
    return out.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in defaults.items() if value is not None})


def classified(neighbours: DataFrame, classes: DataFrame) -> DataFrame:
    """Neighbours (entity, ...) with (entity_type, confidence) of ``classes`` (entity, ord, ...); OTHER and 0.5 where missing."""
    return attach(neighbours, "entity", classes, "entity", "ord", {"entity_type": "OTHER", "confidence": 0.5})


def concrete(neighbours: DataFrame) -> DataFrame:
    """Classified neighbours without abstract ones."""
    return neighbours.where("entity_type != 'ABSTRACT'")


def with_familiarity(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Edges (dst, ...) with the familiarity of their target by ``scores`` (entity, ord, familiarity); 0.5 where missing."""
    return attach(edges, "dst", scores, "entity", "ord", {"familiarity": 0.5})


def branches(chains: int, found: Column) -> Column:
    """How many edges of a node are followed."""
    return F.greatest(F.lit(chains), F.least(F.lit(3), found)).cast("int")


def fan_out(ranked: DataFrame, chains: int) -> DataFrame:
    """The edges (src, rank, ...) that each source follows."""
    return ranked.withColumn("__n", F.count("*").over(Window.partitionBy("src")).cast("int")).where(F.col("rank") <= branches(chains, F.col("__n"))).drop("__n")


def collect_neighbours(candidates: DataFrame, visited: DataFrame, classes: DataFrame, most: int = 20) -> DataFrame:
    """Candidates (src, ord, entity) that are named, not the source, not visited (src, entity) by normalised name, not abstract; the first ``most``."""
    norm = T.norm_entity(F.col("entity"))
    named = candidates.withColumn("__norm", norm).where((F.col("__norm") != "") & (F.col("__norm") != T.norm_entity(F.col("src"))))
    seen = visited.select("src", norm.alias("__norm")).distinct()
    fresh = named.join(seen, ["src", "__norm"], "left_anti")
    once = first_wins(fresh, F.struct("src", "__norm")).drop("__norm")
    return graph.top(concrete(classified(once, classes)), ["src"], [F.col("ord")], most)


def re_extend(chains: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Chains (seed, nodes, relations) grown greedily to ``depth`` hops; those that find no edge stay as they are.

    The next hop is the rarest (frequency, 0 or null counts as 999), then the
    most confident edge to an entity that the chain does not hold.
    ``edges``: valid ones, (src, dst, relation, confidence, frequency).
    """
    rare = F.when(F.coalesce("frequency", F.lit(0)) == 0, 999).otherwise(F.col("frequency"))
    steps = edges.select("src", "dst", "relation", F.struct(rare.alias("rare"), (-F.col("confidence")).alias("confidence"), "dst").alias("order"))
    for _ in range(depth):
        keyed = chains.withColumn("end", F.element_at("nodes", -1))
        short = keyed.where(F.size("nodes") - 1 < depth)
        met = short.join(steps, F.col("end") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        best = met.groupBy("seed", "nodes", "relations").agg(F.min_by(F.struct("dst", "relation"), "order").alias("hop"))
        grown = chains.join(best, ["seed", "nodes", "relations"], "left")
        chains = grown.select(
            "seed",
            F.when(F.col("hop").isNull(), F.col("nodes")).otherwise(F.array_append("nodes", F.col("hop.dst"))).alias("nodes"),
            F.when(F.col("hop").isNull(), F.col("relations")).otherwise(F.array_append("relations", F.col("hop.relation"))).alias("relations"),
        )
    return chains.withColumn("diversity", N.diversity(F.col("nodes"), F.col("relations")))


def context_of(contexts: DataFrame, languages: tuple[str, ...] = ("en", "zh")) -> DataFrame:
    """Per entity the article (entity, language, extract, links, categories) of the first language that says anything."""
    rank = F.array_position(F.array(*map(F.lit, languages)), F.col("language"))
    some = (F.coalesce("extract", F.lit("")) != "") | (F.coalesce(F.size("links"), F.lit(0)) > 0) | (F.coalesce(F.size("categories"), F.lit(0)) > 0)
    kept = contexts.where(some & (rank > 0)).withColumn("__rank", rank)
    return first_wins(kept, F.col("entity"), "__rank").drop("__rank")


def merge_languages(hits: DataFrame, languages: tuple[str, ...] = ("en", "zh"), limit: int = 5) -> DataFrame:
    """Search hits (query, language, ord, id) once each, in order of languages, at most ``limit`` a language in all."""
    rank = F.array_position(F.array(*map(F.lit, languages)), F.col("language"))
    kept = hits.where((F.coalesce("id", F.lit("")) != "") & (rank > 0) & (F.col("ord") < limit)).withColumn("__order", F.struct(rank.alias("l"), F.col("ord").alias("o")))
    once = first_wins(kept, F.struct("query", "id"), "__order")
    return graph.top(once, ["query"], [F.col("__order")], limit * len(languages)).drop("__order")


def with_description(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """Questions that have a root entity, with the visual description of its first row in ``entities`` (name, ord, description)."""
    rooted = questions.where(F.coalesce("root", F.lit("")) != "")
    return attach(rooted, "root", entities, "name", "ord", {"description": None})


def known_targets(transformed: DataFrame, entities: DataFrame) -> DataFrame:
    """Transformed questions whose target entity is among ``entities`` (name)."""
    return transformed.join(entities.select(F.col("name").alias("target_entity")).distinct(), "target_entity", "left_semi")


def with_reasoning_path(transformed: DataFrame, originals: DataFrame) -> DataFrame:
    """Adds the path of the first original (question, ord, reasoning_path) whose text equals ``original_question``."""
    first = first_wins(originals, F.md5("question")).select(F.md5("question").alias("__key"), F.col("question").alias("__text"), "reasoning_path")
    own = transformed.withColumn("__key", F.md5("original_question"))
    return own.join(first, "__key", "left").where(F.col("__text").isNull() | (F.col("__text") == F.col("original_question"))).drop("__key", "__text")


def simplified(questions: DataFrame, answers: DataFrame, least: int = 11) -> DataFrame:
    """Questions (ord, question) with the simplified text at the same place, if that is long enough."""
    short = answers.select("ord", F.col("question").alias("__short"))
    return questions.join(short, "ord", "left").withColumn("question", F.when(P.long_enough(F.col("__short"), least), F.col("__short")).otherwise(F.col("question"))).drop("__short")


def edge_into(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (chain_id, entity) with relation and evidence of the first edge (chain_id, ord, target, ...) that leads to them."""
    first = first_wins(edges, F.struct("chain_id", "target")).select("chain_id", F.col("target").alias("entity"), "relation_type", "evidence")
    return nodes.join(first, ["chain_id", "entity"], "left")


def side_by_side(left: DataFrame, right: DataFrame, place: str = "ord") -> DataFrame:
    """Rows of the same place; the longer side's rest goes."""
    return left.join(right, place)


def indices_union(*sets: DataFrame) -> DataFrame:
    """The distinct indices of all sets."""
    return reduce(DataFrame.union, sets).distinct()


def run_totals(stats: DataFrame, seconds: float) -> DataFrame:
    """(total, samples_per_second, seconds_per_sample) over all datasets."""
    total = F.sum("total")
    return stats.agg(total.alias("total"), N.rate(total, F.lit(seconds), 1.0).alias("samples_per_second"), N.rate(F.lit(seconds), total, 1.0).alias("seconds_per_sample"))


def mean_scores(questions: DataFrame) -> DataFrame:
    """Mean difficulty and uniqueness; a missing score counts 0, no question gives null."""
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"mean_{c}")
    return questions.agg(mean("difficulty_score"), mean("uniqueness_score"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n) of every stage."""
    return reduce(DataFrame.union, [rows.agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name, rows in stages.items()])


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("n"))


def throttled(requests: DataFrame, per_minute: float) -> DataFrame:
    """Adds ``starts``: when each request (api_key, asked, in seconds) may go if a key's requests are spaced evenly.

    next = max(asked, last + interval) unrolls to a running maximum, so a window does it.
    """
    interval = F.lit(60.0 / per_minute)
    w = Window.partitionBy("api_key").orderBy("asked", "request_id")
    place = F.row_number().over(w)
    late = requests.withColumn("__k", place).withColumn("__late", F.col("asked") - F.col("__k") * interval)
    return late.withColumn("starts", F.max("__late").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__k") * interval).drop("__k", "__late")


def assigned_key(request: Column, keys: list[str]) -> Column:
    """One of the keys, the same for equal requests."""
    return F.get(F.array(*map(F.lit, keys)), F.pmod(F.xxhash64(request), F.lit(len(keys))).cast("int"))
