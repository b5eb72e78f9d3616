r"""Text extraction and normalisation as Column functions (no UDFs).

Every function takes and returns Columns, stays inside JVM expressions and
treats null as the reference behaviour asks for.  Patterns use Java's syntax;
"word" classes are spelt out so that results do not depend on Unicode flags.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSISTANT_START, TURN_END = "<|im_start|>assistant", "<|im_end|>"
#: White space as the reference's language knows it: also the separators of ASCII and Unicode.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Patterns of the option letter inside a candidate text.
PUNCTUATED = r"(?i)\(([A-D])\)|\[([A-D])\]|(?<![A-Za-z])([A-D])[.)\]]"
STANDALONE = r"(?<![A-Za-z])([A-D])(?![A-Za-z])"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """Trims and collapses white space."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def _letter_in(text: Column) -> Column:
    """Option letter of a short candidate: alone, then the last with a bracket or stop, then the last standing alone."""
    marked = F.regexp_extract(last_match(text, PUNCTUATED, 0), "([A-Da-d])", 1)
    return F.upper(F.when(F.length(text) == 1, F.when(text.rlike("^[A-Da-d]$"), text)).otherwise(F.coalesce(F.nullif(marked, F.lit("")), last_match(text, STANDALONE))))


def after_reasoning(text: Column) -> Column:
    """What follows the last assistant mark and, within it, the last closed reasoning block."""
    tail = F.try_element_at(F.split(text, r"\Q" + ASSISTANT_START + r"\E"), F.lit(-1))
    return F.try_element_at(F.split(tail, "</think(?:ing)?>"), F.lit(-1))


def mcq_letter(text: Column) -> Column:
    """The option a transcript chooses, A to D, or null.

    An ``<answer>`` tag, or a box that holds one of the letters, decides alone:
    if no letter can be read there, nothing else is tried.
    """
    body = after_reasoning(text)
    tagged = last_match(body, r"(?s)<answer>(.*?)</answer>")
    boxed = strip(F.regexp_extract(body, r"(?i)\\boxed\{([^}]+)\}", 1))
    bold = F.try_element_at(F.filter(F.regexp_extract_all(body, F.lit(r"\*\*[^*]+\*\*"), F.lit(0)), lambda s: s.rlike(r"(?i)\([A-D]\)")), F.lit(-1))
    loose = F.coalesce(
        last_match(body, r"(?i)Answer:\s*\(([A-D])\)"),
        last_match(body, r"(?i)answer is[:\s]*\(([A-D])\)"),
        F.nullif(F.regexp_extract(bold, r"(?i)\(([A-D])\)", 1), F.lit("")),
        last_match(body, r"(?i)\(([A-D])\)"),
        last_match(body, r"(?i)(?<![A-Za-z])([A-D])[)\]]"),
        last_match(body, STANDALONE),
    )
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("string")).when(tagged.isNotNull(), _letter_in(strip(tagged))).when(boxed.rlike("[A-Da-d]"), _letter_in(boxed)).otherwise(F.upper(loose))


def letter_correct(letter: Column, golds: Column) -> Column:
    return F.coalesce(F.exists(golds, lambda g: F.upper(g) == F.upper(letter)), F.lit(False))


def free_answer(text: Column) -> Column:
    """Free-form answer: the last ``<answer>``, else the text up to the end of the turn."""
    body = after_reasoning(text)
    whole = F.try_element_at(F.split(body, r"\Q" + TURN_END + r"\E"), F.lit(1))
    return F.coalesce(strip(F.coalesce(last_match(body, r"(?s)<answer>(.*?)</answer>"), whole)), F.lit(""))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles (unless the text is just "a"), single spaces."""
    bare = F.translate(F.lower(text), ASCII_PUNCTUATION, "")
    return squeeze(F.when(F.trim(bare) == "a", bare).otherwise(F.regexp_replace(bare, r"(?U)\b(?:a|an|the)\b", " ")))


def exact_match(prediction: Column, golds: Column) -> Column:
    mine = normalize_answer(prediction)
    return F.coalesce(F.exists(golds, lambda g: normalize_answer(g) == mine), F.lit(False))


def judge_score(verdict: Column) -> Column:
    """1.0 if the first judge tag says yes, else 0.0."""
    return F.when(F.lower(F.regexp_extract(F.coalesce(verdict, F.lit("")), r"(?i)<judge>\s*(Yes|No)\s*</judge>", 1)) == "yes", 1.0).otherwise(0.0)


def tool_call(text: Column, schema: str = "name string, arguments map<string,string>") -> Column:
    """The first tool call, parsed; null if there is none or it is no JSON."""
    body = F.nullif(strip(F.regexp_extract(text, r"(?s)<tool_call>(.*?)</tool_call>", 1)), F.lit(""))
    return F.from_json(body, schema)


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def cache_key(query: Column, **settings: object) -> Column:
    """md5 over the normalised query and the settings, in their order."""
    parts = [F.concat(F.lit("q="), squeeze(F.lower(query)))] + [F.concat(F.lit(f"{k}="), v if isinstance(v, Column) else F.lit(str(v))) for k, v in settings.items()]
    return F.md5(F.concat_ws("|", *parts))


def file_key(title: Column) -> Column:
    return F.md5(F.translate(title, " /", "__"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def html_text(html: Column, dropped: tuple[str, ...] = ("script", "style")) -> Column:
    """Text of a page: blocks of the dropped elements and comments go, text nodes are joined by line feeds."""
    body = html
    for name in dropped:
        body = F.regexp_replace(body, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->|<![^>]*>", "\n"), "(?s)<[^>]+>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    nodes = F.filter(F.transform(F.split(body, "\n"), strip), lambda n: n != "")
    return F.nullif(F.array_join(nodes, "\n"), F.lit(""))


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight(text: Column, tags: tuple[str, ...] = ("think", "answer", "tool_call", "tool_response")) -> Column:
    """Escaped text with its known tags marked up and line feeds as breaks."""
    text = html_escape(text)
    for tag in tags:
        text = F.regexp_replace(text, f"&lt;(/?{tag})&gt;", f'<span class="tag {tag}">&lt;$1&gt;</span>')
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def page_title(html: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_body(html: Column) -> Column:
    """Inner HTML of the first of article, main and body that the page has."""
    first = [F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1), F.lit("")) for tag in ("article", "main", "body")]
    return F.coalesce(*first)


def word_count(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " "))).cast("long")


def absolute_url(source: Column, page: Column) -> Column:
    """Completes an address of a page's image; null for inline data."""
    return (
        F.when(F.startswith(source, F.lit("data:")), F.lit(None).cast("string"))
        .when(F.startswith(source, F.lit("//")), F.concat(F.lit("https:"), source))
        .when(F.startswith(source, F.lit("/")), F.concat(F.regexp_extract(page, r"^([a-zA-Z]+://[^/?#]+)", 1), source))
        .otherwise(source)
    )


# Words that name the picture, not the thing; each is dropped in these two spellings only.
PICTURE_WORDS = ["Logo", "Icon", "Symbol", "Flag of", "Image", "Photo", "Picture", "Graphic", "Sign", "Mark", "Emblem"]
EDGE_MARKS = " -_,;:"


def clean_entity(name: Column) -> Column:
    words = "|".join(w for word in PICTURE_WORDS for w in (word, word[0].lower() + word[1:]))
    cleaned = F.btrim(F.regexp_replace(F.regexp_replace(name, rf"\b(?:{words})\b", ""), SPACES, " "), F.lit(EDGE_MARKS))
    return F.coalesce(F.nullif(cleaned, F.lit("")), name)


def norm_entity(name: Column) -> Column:
    return F.coalesce(squeeze(F.lower(F.replace(name, F.lit("_"), F.lit(" ")))), F.lit(""))


def strip_fence(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```\w*\n?", ""), r"\n?```$", ""))


def fenced(text: Column) -> Column:
    """What stands inside the first code fence, else the text."""
    inner = F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(.*?)\s*```", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), strip(text))


def _balanced(depth: int) -> str:
    inner = r"[^{}]*"
    for _ in range(depth):
        inner = rf"[^{{}}]*+(?:\{{{inner}\}}[^{{}}]*+)*+"
    return rf"\{{{inner}\}}"


def json_slice(text: Column, depth: int = 8) -> Column:
    """The object of a response.

    Inside a code fence it ends where its braces balance (up to ``depth``
    levels); elsewhere, and where they never do, it goes from the first brace
    to the last; a cut-off object keeps its tail.
    """
    body = fenced(text)
    start, closed = F.instr(body, "{"), F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    counted = F.when(F.contains(text, F.lit("```")), F.nullif(F.regexp_extract(body, rf"(?s)^[^{{]*({_balanced(depth)})", 1), F.lit("")))
    return F.when(start > 0, F.coalesce(counted, F.nullif(closed, F.lit("")), F.substr(body, start)))


def json_field(text: Column, field: str, default: str = "unknown") -> Column:
    """A field of JSON that may be cut off, by pattern; a typed default if it is missing."""
    quoted = F.regexp_extract(text, rf'(?s)"{field}"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    plain = F.regexp_extract(text, rf'"{field}"\s*:\s*(-?[0-9.]+|true|false)', 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit("")), F.lit(default))


def json_objects(text: Column, schema: str) -> Column:
    """All objects of a broken JSON array, those that do not parse left out."""
    found = F.regexp_extract_all(text, F.lit(r"\{[^{}]*(?:\{[^{}]*\})?[^{}]*\}"), F.lit(0))
    return F.transform(F.filter(found, lambda o: F.try_parse_json(o).isNotNull()), lambda o: F.from_json(o, schema))


def entity_lines(text: Column) -> Column:
    """Names of a list, one a line, without numbering and bullets; at least two characters."""
    lines = F.split(strip_fence(text), "\n")
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(strip(x), r"^(?:\d+[.)]|[-•])\s*", "")))
    return F.filter(bare, lambda x: (F.length(x) >= 2) & ~x.rlike(r"\p{Cntrl}"))


def described_lines(text: Column) -> Column:
    """Array of (name, description) of lines ``Name | description``."""
    lines = F.filter(F.split(strip_fence(text), "\n"), lambda x: F.contains(x, F.lit("|")))
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:\d+[.)]|[-•])\s*", ""), r"\[[^\]]*\]", ""), ":.*$", ""))
    both = F.transform(lines, lambda x: F.struct(bare(F.split(x, r"\|", 2)[0]).alias("name"), F.trim(F.split(x, r"\|", 2)[1]).alias("description")))
    return F.filter(both, lambda p: F.length(p["name"]) > 0)


# The operations a fusion plan may name.
OPERATIONS = ["ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "MAX", "MIN", "AVG"]


def fusion_operation(plan: Column) -> Column:
    named = F.upper(F.regexp_extract(plan, r"(?i)(?:\*\*)?Operation(?:\*\*)?\s*:\s*\**\s*([A-Za-z]+)", 1))
    return F.when(named.isin(OPERATIONS), named)


def sentence_with(text: Column, mention: Column, longest: int = 320) -> Column:
    """The first sentence that mentions a term, whatever its case, cut to ``longest`` characters."""
    sentences = F.split(text, r"(?<=[.!?。！？])\s+")
    return F.left(F.try_element_at(F.filter(sentences, lambda s: F.contains(F.lower(s), F.lower(mention))), F.lit(1)), F.lit(longest))


def pick_language(values: Column, languages: list[str]) -> Column:
    """The first non-empty value of the preferred languages, else any."""
    wanted = [F.nullif(F.try_element_at(values, F.lit(code)), F.lit("")) for code in languages]
    return F.coalesce(*wanted, F.try_element_at(F.filter(F.map_values(values), lambda v: v != ""), F.lit(1)), F.lit(""))


def _literal(text: Column) -> Column:
    return F.concat(F.lit(r"(?i)\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def refer_visually(question: Column, entity: Column, reference: Column) -> Column:
    """The question with a visual reference instead of the entity; null if it cannot be placed."""
    safe = F.replace(F.replace(reference, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    low = F.lower(question)
    word = F.try_element_at(F.filter(F.split(entity, SPACES), lambda w: (F.length(w) > 3) & F.contains(low, F.lower(w))), F.lit(1))
    return (
        F.when(F.contains(question, entity), F.replace(question, entity, reference))
        .when(F.contains(low, F.lower(entity)), F.regexp_replace(question, _literal(entity), safe))
        .when(word.isNotNull(), F.regexp_replace(question, _literal(word), safe))
        .when(low.rlike("^(?:where|what is|who is|which)"), F.concat(reference, F.lit(", "), F.lower(F.left(question, F.lit(1))), F.substr(question, F.lit(2))))
    )


# Keywords of entity types and domains, matched as substrings, first list first.
TYPE_KEYWORDS = {
    "PERSON": ["person", "people", "human", " figure", "celebrity", "actor", "scientist", "president", "king", "queen", "emperor"],
    "PLACE": ["city", "country", "place", "location", "building", "tower", "museum", "park", "river", "mountain", "lake", "island", "continent"],
    "ORGANIZATION": ["company", "corporation", "organization", "institution", "agency", "university", "museum", "association"],
    "OBJECT": ["object", "item", "thing", "product", "device", "car", "phone", "machine"],
    "EVENT": ["event", "war", "conference", "festival", "ceremony", "olympics"],
}
DOMAIN_KEYWORDS = {
    "science": ["theory", "scientific", "physics", "chemistry", "biology", "einstein", "newton"],
    "history": ["war", "century", "dynasty", "historical", "ancient", "world war"],
    "geography": ["mountain", "river", "ocean", "continent", "island", "country", "city"],
    "arts": ["painting", "sculpture", "music", "film", "literature", "art", "museum"],
    "business": ["company", "stock", "market", "economic", "corporation", "business"],
}


def by_keywords(text: Column, keywords: dict[str, list[str]], otherwise: str) -> Column:
    """The first class one of whose keywords occurs in the lower-cased text."""
    low, out = F.lower(text), F.lit(otherwise)
    for name, words in reversed(keywords.items()):
        out = F.when(reduce(or_, (F.contains(low, F.lit(word)) for word in words)), name).otherwise(out)
    return out


def entity_type(name: Column) -> Column:
    return by_keywords(name, TYPE_KEYWORDS, "ENTITY")


def domain(question: Column) -> Column:
    return by_keywords(question, DOMAIN_KEYWORDS, "general")


def difficulty(given: Column, steps: Column) -> Column:
    return F.when(given.isin("easy", "medium", "hard"), given).when(steps <= 2, "easy").when(steps <= 4, "medium").otherwise("hard")


def question_id(seed: Column, stamp: Column, place: Column) -> Column:
    return F.concat_ws("_", F.lit("synthesis"), seed, stamp, place.cast("string"))


def item_id(*parts: Column) -> Column:
    """A stable id of seven digits."""
    return F.concat(F.lit("vqa_"), F.lpad(F.pmod(F.xxhash64(*parts), F.lit(10_000_000)).cast("string"), 7, "0"))


def search_context(query: Column, results: Column, longest: int = 30_000) -> Column:
    """A document of numbered results (title, snippet, link), cut to ``longest`` characters."""
    numbered = F.transform(results, lambda r, i: F.concat_ws("\n", F.concat((i + 1).cast("string"), F.lit(". "), r["title"]), r["snippet"], F.coalesce(r["link"], F.lit("No link"))))
    return F.left(F.concat(F.lit("Query: "), query, F.lit("\n\n"), F.array_join(numbered, "\n\n")), F.lit(longest))


def http_code(error: Column) -> Column:
    return F.nullif(F.regexp_extract(error, r"HTTP (\d+)", 1), F.lit(""))


def redact(error: Column, longest: int = 500) -> Column:
    return F.left(F.regexp_replace(error, 'data:image[^"]*', "[IMAGE]"), F.lit(longest))


# Signs of a rate limit in an error message.
LIMIT_SIGNS = ["429", "rate limit", "too many requests", "达到使用量上限", "每分钟请求次数超过限制", "请求次数超过限制"]


def rate_limited(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(LIMIT_SIGNS)), F.lit(False))


def image_mime(path: Column) -> Column:
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.concat(F.lit("image/"), F.when(kind.isin("png", "gif", "webp"), kind).otherwise("jpeg"))


def transcript(parts: Column) -> Column:
    """One string of message parts (type, text): an image mark first if any part is an image."""
    texts = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return F.concat(F.when(F.exists(parts, lambda p: p["type"] != "text"), "[IMAGE 1]\n").otherwise(""), texts)


def first_user_question(prompt: Column) -> Column:
    """The first user message without image marks."""
    content = F.try_element_at(F.filter(prompt, lambda m: m["role"] == "user"), F.lit(1))["content"]
    return strip(F.replace(F.coalesce(content, F.lit("")), F.lit("<image>"), F.lit("")))
