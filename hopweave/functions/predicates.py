"""Filters of the two pipelines as boolean Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopweave.functions.numeric import YEAR

EDGE_CONFIDENCE = 0.9


def valid_edge(confidence: Column, relation: Column, least: float = EDGE_CONFIDENCE) -> Column:
    return (confidence >= least) & ~F.coalesce(relation, F.lit("")).isin("", "none")


# Beginnings and parts of article titles and categories that say nothing about a thing.
LINK_PREFIXES = ["list of ", "lists of ", "index of ", "outline of ", "timeline of ", "glossary of "]
LINK_PARTS = ["disambiguation", "bibliography", "discography", "filmography", "template:", "category:", "portal:", "draft:", "help:", "wikipedia:"]
CATEGORY_PREFIXES = ["articles ", "all articles", "all pages", "pages ", "wikipedia ", "cs1 ", "webarchive ", "use ", "commons category", "short description", "coordinates ", "hidden categories"]
CATEGORY_PARTS = [
    "articles with", "articles needing", "articles lacking", "articles containing", "all stub articles", "stub articles", "maintenance", "cleanup",
    "unreferenced", "wikidata", "infobox", "disambiguation", "redirects", "births", "deaths",
]


def _noisy(text: Column, prefixes: list[str], parts: list[str], shapes: str) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (low == "") | low.rlike(f"^(?:{'|'.join(prefixes)})|{'|'.join(parts)}|{shapes}")


def noisy_link(title: Column) -> Column:
    return _noisy(title, LINK_PREFIXES, LINK_PARTS, r"^\d{3,4}$|^\d{1,2}(?:st|nd|rd|th)? century$|^\d{4} in .+$|^.+ in \d{4}$")


def noisy_category(category: Column) -> Column:
    return _noisy(category, CATEGORY_PREFIXES, CATEGORY_PARTS, r"^\d{3,4}s? .*$")


# Extensions of files that are no pages, for the evaluator and for the stand-alone fetcher.
SKIPPED_EXTENSIONS = ["pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "jpg", "jpeg", "png", "gif"]
FETCHER_EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "gif", "zip", "mp4", "mp3", "exe"]


def skipped_url(url: Column, extensions: list[str] = SKIPPED_EXTENSIONS) -> Column:
    return F.coalesce(F.lower(url).rlike(rf"\.(?:{'|'.join(extensions)})$"), F.lit(False))


def readable_page(status: Column, content_type: Column) -> Column:
    return (status < 400) & F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))


# Words of abstract notions.
ABSTRACT_WORDS = ["theory", "concept", "idea", "philosophy", "method", "process"]


def valid_entity(name: Column, least: int = 2, most: int = 50) -> Column:
    abstract = F.lower(name).rlike("|".join(ABSTRACT_WORDS)) & ~name.rlike(r"[A-Z][a-z]+['\"]?\s+\w+")
    return F.length(name).between(least, most) & ~name.rlike(r"^\d{4}$") & ~abstract & name.rlike("[a-zA-Z]")


def good_image(url: Column, width: Column, height: Column, side: int = 400) -> Column:
    return (width >= side) & (height >= side) & ~F.lower(url).rlike("thumb|preview")


def leaks_answer(question: Column, answer: Column) -> Column:
    """Whether a word of three letters or more, or a year, of the answer occurs in the question."""
    low = F.lower(question)
    word = F.exists(F.split(F.lower(answer), r"\s+"), lambda w: (F.length(w) >= 3) & F.contains(low, w))
    return word | F.exists(F.regexp_extract_all(answer, F.lit(YEAR), F.lit(1)), lambda y: F.contains(question, y))


def mask_years(question: Column, answer: Column) -> Column:
    """The question with the answer's years blanked."""
    years = F.array_distinct(F.regexp_extract_all(answer, F.lit(YEAR), F.lit(1)))
    return F.aggregate(years, question, lambda text, year: F.replace(text, year, F.lit("[YEAR]")))


def long_enough(text: Column, least: int) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= least


def leak_route(solved: Column, leaked: Column, model_issue: Column) -> Column:
    """Where a judged question goes; a question without judgment is kept."""
    return F.when(solved & leaked, "rewrite").when(~solved & model_issue, "keep_model_issue").when(~solved & ~model_issue, "rewrite").otherwise("keep")


def covers(a: Column, b: Column) -> Column:
    """Whether one answer contains the other, whatever the case; an empty answer never does."""
    a, b = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
