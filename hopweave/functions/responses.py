"""Typed reading of model responses: JSON in or out of a code fence, with defaults and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopweave.functions import text as T

# The entity types a classifier may name.
ENTITY_TYPES = [
    "PER", "ORG", "LOC", "PROD", "EVENT", "WOA", "ANIMAL", "PLANT", "VEHICLE", "FOOD", "DISH", "MATERIAL", "BUILDING", "BRAND", "TECH", "MEDICAL", "NAT", "OTHER", "ABSTRACT",
]


def known_type(name: Column) -> Column:
    return F.when(name.isin(ENTITY_TYPES), name).otherwise("OTHER")


def _list(text: Column, fields: str) -> Column:
    return F.from_json(T.strip_fence(text), f"array<struct<{fields}>>")


def classifications(text: Column) -> Column:
    """Array of (entity, entity_type, confidence); unknown types are OTHER, rows without an entity go; null for no JSON."""
    rows = F.filter(_list(text, "entity:string,entity_type:string,confidence:double"), lambda r: F.coalesce(r["entity"], F.lit("")) != "")
    return F.transform(rows, lambda r: F.struct(r["entity"].alias("entity"), known_type(r["entity_type"]).alias("entity_type"), F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence")))


def verdicts(text: Column, most: Column) -> Column:
    """Array of (index, relation_type, confidence, evidence) with 1 <= index <= ``most``; empty for no JSON list."""
    rows = F.filter(_list(text, "index:int,relation_type:string,confidence:double,evidence:string"), lambda r: (r["index"] >= 1) & (r["index"] <= most))
    typed = F.transform(
        rows,
        lambda r: F.struct(r["index"].alias("index"), F.coalesce(r["relation_type"], F.lit("none")).alias("relation_type"), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(r["evidence"], F.lit("")).alias("evidence")),
    )
    return F.coalesce(typed, F.array().cast("array<struct<index:int,relation_type:string,confidence:double,evidence:string>>"))


def joined_evidence(said: Column, found: Column, longest: int = 700) -> Column:
    """The model's evidence with what was found outside, unless it holds that already."""
    said, found = F.coalesce(said, F.lit("")), F.coalesce(found, F.lit(""))
    cut = F.left(found, F.lit(longest))
    return F.when((found == "") | F.contains(said, found), said).when(said == "", cut).otherwise(F.concat(said, F.lit(" | Evidence: "), cut))


def picks(text: Column) -> Column:
    """The whole numbers of ``indices``; null for no JSON."""
    numbers = F.from_json(T.strip_fence(text), "struct<indices:array<string>>")["indices"]
    return F.transform(F.filter(numbers, lambda n: n.rlike("^-?[0-9]+$")), lambda n: n.cast("int"))


def picked(candidates: Column, text: Column, most: int) -> Column:
    """The candidates (names) that a response picks by position: no blank, no repeat, at most ``most``; else the first ones."""
    chosen = F.transform(F.filter(picks(text), lambda i: (i >= 1) & (i <= F.size(candidates))), lambda i: F.get(candidates, i - 1))
    named = F.filter(chosen, lambda c: T.strip(c) != "")
    lows = F.transform(named, lambda c: F.lower(T.strip(c)))
    fresh = F.filter(named, lambda c, i: F.array_position(lows, F.lower(T.strip(c))) == i + 1)
    return F.when(F.size(fresh) > 0, F.slice(fresh, 1, most)).otherwise(F.slice(candidates, 1, most))


def familiarity(text: Column) -> Column:
    """Map entity -> score of ``familiarity_scores``, the last entry of an entity counts; a missing score is 0.5."""
    rows = F.from_json(T.strip_fence(text), "struct<familiarity_scores:array<struct<entity:string,score:double>>>")["familiarity_scores"]
    kept = F.filter(rows, lambda r: F.coalesce(r["entity"], F.lit("")) != "")
    last = F.filter(kept, lambda r, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["entity"] == r["entity"]))
    return F.map_from_entries(F.transform(last, lambda r: F.struct(r["entity"].alias("entity"), F.coalesce(r["score"], F.lit(0.5)).alias("score"))))


def wikidata_evidence(source: Column, target: Column, relation: Column, property_id: Column, entity_id: Column, extract: Column, url: Column) -> Column:
    """Struct (text, sources): the claim, and the first sentence of the article that mentions the target."""
    sentence = F.nullif(F.when(target != "", T.sentence_with(extract, target)), F.lit(""))
    claim = F.concat(F.lit("Wikidata "), property_id, F.lit(" ("), relation, F.lit(") links "), source, F.lit(" to "), target, F.lit("."))
    origin = lambda kind, at, detail, pid, eid: F.struct(F.lit(kind).alias("source"), at.alias("url"), detail.alias("detail"), pid.alias("property_id"), eid.alias("target_entity_id"))
    none = F.lit(None).cast("string")
    sources = F.array_compact(F.array(origin("wikidata", none, relation, property_id, entity_id), F.when(sentence.isNotNull(), origin("wikipedia", url, sentence, none, none))))
    return F.struct(F.concat_ws(" ", claim, F.concat(F.lit("Wikipedia sentence: "), sentence)).alias("text"), sources.alias("sources"))


def claim_ids(claims: Column) -> Column:
    """The distinct target ids of an array of claims (value_type, target_id)."""
    ids = F.transform(F.filter(claims, lambda c: c["value_type"] == "wikibase-entityid"), lambda c: c["target_id"])
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: F.coalesce(i, F.lit("")) != "")))
