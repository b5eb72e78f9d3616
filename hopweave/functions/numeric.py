"""Numeric rules as Column functions: resizing, boxes, scores, fusion folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column, factor: int) -> Column:
    """The nearest multiple; halves go to the even one."""
    return (F.bround(x / factor, 0) * factor).cast("long")


def ceil_to(x: Column, factor: int) -> Column:
    return (F.ceil(x / factor) * factor).cast("long")


def floor_to(x: Column, factor: int) -> Column:
    return (F.floor(x / factor) * factor).cast("long")


def smart_resize(height: Column, width: Column, factor: int = 32, least: int = 65_536, most: int = 8_294_400) -> Column:
    """Struct (height, width): multiples of ``factor`` whose area lies between the bounds.

    An aspect ratio over 200 is an error.  Shrinking truncates before it
    rounds down, as the scaled side is a whole number of pixels.
    """
    ratio = F.greatest(height, width) / F.least(height, width)
    h, w = F.greatest(F.lit(factor), round_to(height, factor)), F.greatest(F.lit(factor), round_to(width, factor))
    shrink, grow = F.sqrt(height * width / most), F.sqrt(least / (height * width))
    side = lambda aligned, own: (
        F.when(h * w > most, F.greatest(F.lit(factor).cast("long"), floor_to((own / shrink).cast("long"), factor))).when(h * w < least, ceil_to(own * grow, factor)).otherwise(aligned)
    )
    return F.when(ratio > 200, F.raise_error(F.lit("aspect ratio over 200"))).otherwise(F.struct(side(h, height).cast("long").alias("height"), side(w, width).cast("long").alias("width")))


def limit_area(height: Column, width: Column, most: int) -> Column:
    """Struct (height, width) scaled down to an area, in whole pixels."""
    scale = F.least(F.lit(1.0), F.sqrt(most / (height * width)))
    return F.struct((height * scale).cast("long").alias("height"), (width * scale).cast("long").alias("width"))


def fit_inside(height: Column, width: Column, side: int = 4096) -> Column:
    scale = F.least(F.lit(1.0), side / width, side / height)
    return F.struct((height * scale).cast("long").alias("height"), (width * scale).cast("long").alias("width"))


def box_pixels(box: Column, height: Column, width: Column, padding: float = 0.0, most_padding: int = 600, least_side: int = 28) -> Column:
    """Pixel box (left, top, right, bottom) of a box in thousandths; null if a side is under ``least_side``."""
    share = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), box[i] / 1000))
    pad_x, pad_y = (F.least(F.lit(float(most_padding)), (share(i + 2) - share(i)) * size * padding) for i, size in ((0, width), (1, height)))
    left, top = F.greatest(F.lit(0), (share(0) * width - pad_x).cast("int")), F.greatest(F.lit(0), (share(1) * height - pad_y).cast("int"))
    right, bottom = F.least(width.cast("int"), (share(2) * width + pad_x).cast("int")), F.least(height.cast("int"), (share(3) * height + pad_y).cast("int"))
    return F.when((right - left >= least_side) & (bottom - top >= least_side), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


# Names of the ways to turn an answer into a number, with aliases.
METHODS = ["first_letter_ascii_sum", "founded_year", "founded_year_diff", "character_count", "digit_sum", "word_count", "vowel_count"]
METHOD_ALIASES = {"first_letter_ascii": "first_letter_ascii_sum", "founding_year": "founded_year", "founding_year_diff": "founded_year_diff"}
YEAR = r"(?<![\p{L}\p{N}_])(1[0-9]{3}|20[0-2][0-9])(?![\p{L}\p{N}_])"


def answer_value(answer: Column, method: Column, reported: Column, year_now: int = 2026) -> Column:
    """The number an answer stands for by a method; the reported one where the method is unknown or finds none."""
    text = F.coalesce(answer, F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    way = method
    for alias, name in METHOD_ALIASES.items():
        way = F.when(method == alias, name).otherwise(way)
    year = F.nullif(F.regexp_extract(text, YEAR, 1), F.lit("")).cast("double")
    digits = F.regexp_extract_all(text, F.lit(r"\d"), F.lit(0))
    return (
        F.when(F.trim(text) == "", 0.0)
        .when(way == "first_letter_ascii_sum", F.aggregate(words, F.lit(0), lambda s, w: s + F.ascii(w)).cast("double"))
        .when(way == "founded_year", F.coalesce(year, reported))
        .when(way == "founded_year_diff", F.coalesce(year_now - year, reported))
        .when(way == "character_count", F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]", "")).cast("double"))
        .when(way == "digit_sum", F.aggregate(digits, F.lit(0), lambda s, d: s + d.cast("int")).cast("double"))
        .when(way == "word_count", F.size(words).cast("double"))
        .when(way == "vowel_count", F.size(F.regexp_extract_all(text, F.lit("[aeiouAEIOU]"), F.lit(0))).cast("double"))
        .otherwise(reported)
    )


def fuse(values: Column, rule: Column) -> Column:
    """Folds ordered values by a rule; none give 0, one gives itself, unknown rules give 0."""
    rest, first = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return (
        F.when(F.size(values) <= 0, 0.0)
        .when(F.size(values) == 1, first)
        .when(rule == "ADD", total)
        .when(rule == "SUBTRACT", F.aggregate(rest, first, lambda a, v: a - v))
        .when(rule == "MULTIPLY", F.aggregate(values, F.lit(1.0), lambda a, v: a * v))
        .when((rule == "DIVIDE") & (F.get(values, F.lit(1)) != 0), F.aggregate(rest, first, lambda a, v: F.when(v != 0, a / F.nullif(v, F.lit(0.0))).otherwise(a)))
        .when(rule == "MAX", F.array_max(values))
        .when(rule == "MIN", F.array_min(values))
        .when(rule == "AVG", total / F.size(values))
        .otherwise(0.0)
    )


def plain_number(x: Column) -> Column:
    """A whole number without its decimal point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def fusion_text(values: Column, rule: Column) -> Column:
    """How the values were fused, in words."""
    shown = F.transform(values, plain_number)
    sign = F.when(rule == "ADD", " + ").when(rule == "SUBTRACT", " - ").when(rule == "MULTIPLY", " × ").when(rule == "DIVIDE", " ÷ ")
    result = fuse(values, rule)
    result = plain_number(F.when(rule.isin("DIVIDE", "AVG"), F.bround(result, 2)).otherwise(result))
    body = F.when(sign.isNotNull(), F.aggregate(F.slice(shown, 2, F.greatest(F.size(shown) - 1, F.lit(0))), F.get(shown, F.lit(0)), lambda a, v: F.concat(a, sign, v))).when(
        rule.isin("MAX", "MIN", "AVG"), F.concat(F.lower(rule), F.lit("("), F.array_join(shown, ", "), F.lit(")"))
    )
    return (
        F.when(F.size(values) <= 0, "No values to fuse")
        .when(F.size(values) == 1, F.concat(F.lit("Single value: "), F.get(values, F.lit(0)).cast("string")))
        .when((rule == "DIVIDE") & (F.get(values, F.lit(1)) == 0), F.lit(""))
        .otherwise(F.coalesce(F.concat(body, F.lit(" = "), result), F.lit("")))
    )


def diversity(entities: Column, relations: Column) -> Column:
    """1 for at most one entity, else weighted breadth and variety of relations."""
    varied = F.when(F.size(relations) > 0, F.least(F.lit(1.0), F.size(F.array_distinct(relations)) / F.nullif(F.size(relations), F.lit(0)))).otherwise(0.0)
    return F.when(F.size(entities) <= 1, 1.0).otherwise(0.6 * F.least(F.lit(1.0), F.size(entities) / 10) + 0.4 * varied)


def expansion_priority(novelty: Column, entity_novelty: Column, confidence: Column) -> Column:
    return 0.4 * novelty + 0.3 + 0.2 * entity_novelty + 0.1 * confidence


def candidate_score(rank: Column, query: Column, labels: Column, description: Column, sitelinks: Column, instances: Column) -> Column:
    """How well a search hit fits a name; ``query`` and ``labels`` are normalised."""
    low = F.lower(F.coalesce(description, F.lit("")))
    part = F.exists(labels, lambda x: (query != "") & (F.contains(x, query) | F.contains(query, x)))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return (
        F.greatest(F.lit(0), 5 - rank)
        + F.when(F.array_contains(labels, query), 10).when(part, 4).otherwise(0)
        + points(low != "", 1)
        + points(F.try_element_at(sitelinks, F.lit("enwiki")) != "", 3)
        + points(F.try_element_at(sitelinks, F.lit("zhwiki")) != "", 2)
        - points(F.array_contains(instances, "Q4167410") | F.contains(low, F.lit("disambiguation")), 20)
        - points(F.contains(low, F.lit("wikimedia category")) | F.contains(low, F.lit("category page")), 8)
    ).cast("int")


def rate(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole * scale; 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * scale, whole), F.lit(0.0))


# The wait before retry n, in seconds, by kind of call.
BACKOFFS = {
    "search": lambda n: F.lit(1.0) * (n + 1),
    "fetch": lambda n: F.least(F.pow(F.lit(2.0), n), F.lit(5.0)),
    "model": lambda n: F.least(F.pow(F.lit(2.0), n), F.lit(32.0)),
    "limit": lambda n: 4 + F.pow(F.lit(2.0), F.least(n, F.lit(6))),
    "summary_cache": lambda n: 0.05 * F.pow(F.lit(2.0), n),
    "query_cache": lambda n: 0.1 * F.pow(F.lit(2.0), n),
    "summary": lambda n: F.lit(1.0) + 0 * n,
}
