"""Queries over the driver's tables, each with the same query in SQL.

The tables hold no transcripts with answer marks, so queries about them wrap
texts in marks by a rule on the ids, the same in both languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions import numeric as N
from hopweave.functions import predicates as P
from hopweave.functions import text as T
from hopweave.operators import graph, keyed, merge, quality, scoring
from hopweave.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(x: Column) -> Column:
    return x.cast("long")


# ---- transcripts: extraction and scores

#: Four shapes of a marked answer by conv_id % 4, on top of the conversation's text.
_LETTER = "substr('ABCD', CAST(conv_id % 4 AS INT) + 1, 1)"
_MARKED = f"""concat('<|im_start|>assistant\n<think>(D)</think>', CASE CAST(turn % 6 AS INT)
    WHEN 0 THEN concat('<answer>\n\t', {_LETTER}, '\n</answer>') WHEN 1 THEN concat('so \\boxed{{', {_LETTER}, '}}') WHEN 2 THEN concat('Answer: (', {_LETTER}, ')')
    WHEN 3 THEN concat('the answer is (', {_LETTER}, ').') WHEN 4 THEN concat('I choose **', '(', {_LETTER}, ')** here (x)') ELSE concat('<answer>none of them</answer> (', {_LETTER}, ')') END, '\n<|im_end|>')"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rows.withColumn("output", F.expr(_MARKED.replace("\\boxed", "\\\\boxed")))


@query(f"""
WITH t AS (SELECT conv_id, turn, {_MARKED} AS output FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN NULL ELSE {_LETTER} END AS letter FROM t
""")
def mcq_extract(spark, sf_dir):
    return transcripts(spark, sf_dir).select("conv_id", "turn", T.mcq_letter(F.col("output")).alias("letter"))


@query(f"""
SELECT conv_id, turn, CASE CAST(turn % 6 AS INT)
    WHEN 0 THEN {_LETTER} WHEN 1 THEN concat('so \\boxed{{', {_LETTER}, '}}') WHEN 2 THEN concat('Answer: (', {_LETTER}, ')')
    WHEN 3 THEN concat('the answer is (', {_LETTER}, ').') WHEN 4 THEN concat('I choose **', '(', {_LETTER}, ')** here (x)') ELSE 'none of them' END AS answer FROM conversations
""".replace("\\\\boxed", "\\boxed"))
def answer_extract(spark, sf_dir):
    return transcripts(spark, sf_dir).select("conv_id", "turn", T.free_answer(F.col("output")).alias("answer"))


@query("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM conversations")
def judge_verdict(spark, sf_dir):
    verdict = F.concat(F.col("text"), F.lit("<judge> "), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "YES").otherwise("no"), F.lit(" </judge><judge>yes</judge>"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.judge_score(verdict).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'search' END AS name, CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) END AS query FROM conversations")
def tool_call_parse(spark, sf_dir):
    call = F.concat(F.lit('x <tool_call>{"name": "search", "arguments": {"query": "'), F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, '"}}').otherwise('"'), F.lit("</tool_call>"))
    parsed = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.tool_call(call).alias("call"))
    return parsed.select("conv_id", "turn", F.col("call.name").alias("name"), F.col("call.arguments")["query"].alias("query"))


@query("SELECT conv_id, turn, trim(role || ' ' || CAST(turn AS VARCHAR)) AS shown FROM conversations")
def strip_think(spark, sf_dir):
    text = F.concat(F.lit("<think>"), "text", F.lit("</think>\n\t"), "role", F.lit(" <THINK>a\nb</think>"), F.col("turn").cast("string"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_think(text).alias("shown"))


_ARTICLE = r"'(^|[^\p{L}\p{N}_])(?:a|an|the)([^\p{L}\p{N}_]|$)', '\1 \2', 'g'"
_BARE = "translate(lower(p_name), '" + T.ASCII_PUNCTUATION.replace("'", "''") + "', '')"


@query(rf"""
WITH b AS (SELECT p_partkey, {_BARE} AS bare FROM part)
SELECT p_partkey, trim(regexp_replace(CASE WHEN trim(bare) = 'a' THEN bare ELSE regexp_replace(regexp_replace(bare, {_ARTICLE}), {_ARTICLE}) END, '\s+', ' ', 'g')) AS name FROM b
""")
def normalize_answer(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.normalize_answer(F.col("p_name")).alias("name"))


@query("""
WITH g AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN ['The ' || role || '!', 'x'] ELSE ['other', 'y'] END AS golds, role FROM conversations)
SELECT conv_id, turn, conv_id % 3 = 0 AS correct FROM g
""")
def em_score(spark, sf_dir):
    golds = F.when(F.col("conv_id") % 3 == 0, F.array(F.concat(F.lit("The "), "role", F.lit("!")), F.lit("x"))).otherwise(F.array(F.lit("other"), F.lit("y")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.exact_match(F.upper("role"), golds).alias("correct"))


@query("""
WITH r AS (
    SELECT source AS dataset, CAST(quality AS DOUBLE) AS em, CAST(toxic AS DOUBLE) AS llm, CASE WHEN d.doc_id % 17 = 0 THEN 'HTTP 500' END AS error
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
SELECT dataset, count(*) AS total, count(error) AS errors, count(CASE WHEN em > 0.5 THEN 1 END) AS em_correct, count(em) AS em_total,
    count(CASE WHEN llm > 0.5 THEN 1 END) AS llm_correct, count(llm) AS llm_total,
    round(CASE WHEN count(em) > 0 THEN count(CASE WHEN em > 0.5 THEN 1 END) / count(em) END, 6) AS em_accuracy,
    round(CASE WHEN count(llm) > 0 THEN count(CASE WHEN llm > 0.5 THEN 1 END) / count(llm) END, 6) AS llm_accuracy
FROM r GROUP BY dataset
UNION ALL SELECT 'empty', 0, 0, 0, 0, 0, 0, NULL, NULL
""")
def dataset_stats(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("em_score_mcq"), F.col("toxic").cast("double").alias("llm_score"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"))
    results = docs.join(labels, "doc_id", "left").withColumn("error", F.when(F.col("doc_id") % 17 == 0, "HTTP 500"))
    listed = docs.select("dataset").distinct().unionByName(spark.createDataFrame([("empty",)], "dataset string"))
    return scoring.dataset_stats(results, listed).withColumns({c: F.round(c, 6) for c in ("em_accuracy", "llm_accuracy")})


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark, sf_dir):
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"))
    return keyed.pending(read(spark, sf_dir, "documents").select("doc_id", "source"), done, "doc_id")


@query(r"""
SELECT conv_id, string_agg(CASE WHEN turn % 4 = 3 THEN '[IMAGE 1]' || chr(10) ELSE '' END || role || chr(10) || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id
""")
def transcript_render(spark, sf_dir):
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    parts = F.array(part("text", F.col("role")), part("text", F.col("text")))
    parts = F.when(F.col("turn") % 4 == 3, F.array_append(parts, part("image", F.lit("")))).otherwise(parts)
    shown = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", T.transcript(parts).alias("line"))
    return shown.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "line"))), lambda x: x["line"]), "\n").alias("transcript"))


# ---- caches

_KEY = "md5('q=' || trim(regexp_replace(lower(event_type || '  ' || CAST(user_id AS VARCHAR)), '\\s+', ' ', 'g')) || '|k=10|model=m')"


@query(f"SELECT event_id, {_KEY} AS key FROM events")
def cache_key(spark, sf_dir):
    text = F.concat("event_type", F.lit("  "), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", T.cache_key(text, k=10, model="m").alias("key"))


def _store(spark, sf_dir) -> DataFrame:
    text = F.concat("event_type", F.lit("  "), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select(T.cache_key(text, k=10, model="m").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").alias("created_at"))


@query(f"""
SELECT key, value FROM (SELECT {_KEY} AS key, CAST(event_id AS VARCHAR) AS value, row_number() OVER (PARTITION BY {_KEY} ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events) WHERE n = 1
""")
def cache_upsert(spark, sf_dir):
    rows = _store(spark, sf_dir)
    return keyed.upsert(rows.where("cast(value AS bigint) % 2 = 0"), rows.where("cast(value AS bigint) % 2 = 1")).select("key", "value")


@query(f"""
WITH store AS (SELECT DISTINCT {_KEY} AS key FROM events WHERE event_id % 2 = 0), asked AS (SELECT {_KEY} AS key FROM events)
SELECT count(s.key) AS hits, count(*) - count(s.key) AS misses, round(count(s.key) / count(*), 6) AS hit_rate FROM asked a LEFT JOIN store s ON a.key = s.key
""")
def cache_stats(spark, sf_dir):
    rows = _store(spark, sf_dir)
    stored = keyed.last_wins(rows.where("cast(value AS bigint) % 2 = 0"), "key", ["created_at", "value"])
    return keyed.hit_stats(keyed.lookup(rows.select("key"), stored)).withColumn("hit_rate", F.round("hit_rate", 6))


# ---- pages

_HTML = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', chr(10), 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', chr(10), 'g'), '(?s)<!--.*?-->|<![^>]*>', chr(10), 'g'), '(?s)<[^>]+>', chr(10), 'g')"
_UNESCAPED = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(f"SELECT page_id, nullif(array_to_string(list_filter(list_transform(string_split({_UNESCAPED.format(_HTML)}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)), '') AS text FROM pages")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query()
def html_text_dom(spark, sf_dir):
    from hopweave.sources.pages import dom_text

    return read(spark, sf_dir, "pages").select("page_id", dom_text(F.col("html")).alias("page")).select("page_id", "page.title", "page.text")


@query(r"""
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
    len(list_filter(string_split_regex(regexp_replace(regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article>', 1), '<[^>]+>', ' ', 'g'), '\s+'), lambda w: w <> '')) AS words
FROM pages
""")
def page_parse(spark, sf_dir):
    body = F.regexp_replace(T.page_body(F.col("html")), "<[^>]+>", " ")
    return read(spark, sf_dir, "pages").select("page_id", T.page_title(F.col("html")).alias("title"), T.word_count(body).alias("words"))


@query(r"SELECT page_id, regexp_matches(lower(url || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '' END), '\.(pdf|doc|docx|ppt|pptx|xls|xlsx|jpg|jpeg|png|gif)$') AS skipped FROM pages")
def url_skip(spark, sf_dir):
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(""))
    return read(spark, sf_dir, "pages").select("page_id", P.skipped_url(url).alias("skipped"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS snippet FROM pages")
def snippet_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("snippet"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'https://img.example/x.png' ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/x.png' END AS image FROM pages")
def image_urls(spark, sf_dir):
    source = F.when(F.col("page_id") % 3 == 0, "data:image/png;base64,x").when(F.col("page_id") % 3 == 1, "//img.example/x.png").otherwise("/x.png")
    return read(spark, sf_dir, "pages").select("page_id", T.absolute_url(source, F.col("url")).alias("image"))


# ---- entities

_WORDS = "|".join(w for word in T.PICTURE_WORDS for w in (word, word[0].lower() + word[1:]))


@query(rf"""
WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Logo' ELSE 'Flag of ' || p_name || ' -  logo,' END AS name FROM part)
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(name, '\b(?:{_WORDS})\b', '', 'g'), '\s+', ' ', 'g'), ' -_,;:'), ''), name) AS cleaned FROM e
""")
def entity_clean(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 5 == 0, "Logo").otherwise(F.concat(F.lit("Flag of "), "p_name", F.lit(" -  logo,")))
    return read(spark, sf_dir, "part").select("p_partkey", T.clean_entity(name).alias("cleaned"))


@query(r"SELECT s_suppkey, trim(regexp_replace(lower(replace('  ' || s_name || '_X ', '_', ' ')), '\s+', ' ', 'g')) AS name FROM supplier")
def entity_norm(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.norm_entity(F.concat(F.lit("  "), "s_name", F.lit("_X "))).alias("name"))


@query("SELECT arg_min(p_partkey, p_partkey) AS p_partkey, lower(p_brand || ' ' || p_type) AS name, min(p_partkey) AS ord FROM part GROUP BY lower(p_brand || ' ' || p_type)")
def entity_dedupe(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("name"), F.col("p_partkey").alias("ord"))
    return merge.first_wins(rows, F.col("name"))


@query("SELECT p_partkey, CAST(2 AS BIGINT) AS n, trim(p_name) AS first FROM part")
def line_parse(spark, sf_dir):
    text = F.concat(F.lit("```text\n1. "), "p_name", F.lit("\n- x\n• second thing\n```"))
    lines = T.entity_lines(text)
    return read(spark, sf_dir, "part").select("p_partkey", long(F.size(lines)).alias("n"), F.get(lines, F.lit(0)).alias("first"))


@query("SELECT p_partkey, trim(p_name) AS name, 'd|' || p_type AS description FROM part")
def described_line_parse(spark, sf_dir):
    lines = T.described_lines(F.concat(F.lit("no mark\n2) "), "p_name", F.lit(" [x]: y | d|"), "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.get(lines, F.lit(0))["name"].alias("name"), F.get(lines, F.lit(0))["description"].alias("description"))


# ---- text, answers and leaks

@query(r"""
SELECT doc_id, left(list_filter(string_split_regex(replace(replace(replace(text, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), chr(1)), lambda s: contains(lower(s), lower(lang)))[1], 320) AS sentence FROM (SELECT doc_id, lang, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents)
""")
def sentence_mention(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return docs.select("doc_id", T.sentence_with(F.col("text"), F.col("lang")).alias("sentence"))


_ANSWER = "concat('Est. ', CAST(1200 + doc_id % 900 AS {0}), ', moved 1974: ', {1})"
_METHOD = "CASE CAST(doc_id % 8 AS INT) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate([*N.METHODS, "unknown"])) + " END"


@query(rf"""
WITH a AS (SELECT doc_id, {_ANSWER.format('VARCHAR', 'source')} AS answer, {_METHOD} AS method FROM documents),
w AS (SELECT *, list_filter(string_split_regex(answer, '\s+'), lambda x: x <> '') AS words, regexp_extract(answer, '(?:^|[^\p{{L}}\p{{N}}_])(1[0-9]{{3}}|20[0-2][0-9])(?:[^\p{{L}}\p{{N}}_]|$)', 1) AS year FROM a)
SELECT doc_id, method, CAST(CASE method
    WHEN 'first_letter_ascii_sum' THEN list_sum(list_transform(words, lambda x: ascii(x)))
    WHEN 'founded_year' THEN coalesce(TRY_CAST(year AS DOUBLE), -1.0) WHEN 'founded_year_diff' THEN coalesce(2026 - TRY_CAST(year AS DOUBLE), -1.0)
    WHEN 'character_count' THEN length(regexp_replace(answer, '[^\p{{L}}\p{{N}}_]', '', 'g'))
    WHEN 'digit_sum' THEN list_sum(list_transform(regexp_extract_all(answer, '[0-9]'), lambda x: CAST(x AS INT)))
    WHEN 'word_count' THEN len(words) WHEN 'vowel_count' THEN len(regexp_extract_all(answer, '[aeiouAEIOU]')) ELSE -1.0 END AS DOUBLE) AS value FROM w
""")
def answer_to_number(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(_ANSWER.format("STRING", "source")).alias("answer"), F.expr(_METHOD).alias("method"))
    return docs.select("doc_id", "method", N.answer_value(F.col("answer"), F.col("method"), F.lit(-1.0)).alias("value"))


@query(r"""
SELECT doc_id, len(list_filter(string_split_regex(lower(source || ' in ' || CAST(1200 + doc_id % 900 AS VARCHAR)), '\s+'), lambda w: length(w) >= 3 AND contains(lower(text), w))) > 0 AS leaks FROM documents
""")
def leak_check(spark, sf_dir):
    answer = F.concat("source", F.lit(" in "), (F.col("doc_id") % 900 + 1200).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", P.leaks_answer(F.col("text"), answer).alias("leaks"))


@query("SELECT doc_id, CASE WHEN 1200 + doc_id % 900 < 2030 THEN replace(text || CAST(1200 + doc_id % 900 AS VARCHAR), CAST(1200 + doc_id % 900 AS VARCHAR), '[YEAR]') ELSE text || CAST(1200 + doc_id % 900 AS VARCHAR) END AS masked FROM documents")
def leak_sanitize(spark, sf_dir):
    year = (F.col("doc_id") % 900 + 1200).cast("string")
    return read(spark, sf_dir, "documents").select("doc_id", P.mask_years(F.concat("text", year), F.concat(F.lit("in "), year)).alias("masked"))


def _cases(keywords: dict, column: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{'|'.join(w)}') THEN '{n}'" for n, w in keywords.items()) + f" ELSE '{otherwise}' END"


@query(f"SELECT doc_id, {_cases(T.DOMAIN_KEYWORDS, 'text', 'general')} AS domain FROM documents")
def domain_bucket(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.domain(F.col("text")).alias("domain"))


@query(f"SELECT doc_id, {_cases(T.TYPE_KEYWORDS, 'text', 'ENTITY')} AS type FROM documents")
def entity_type_infer(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.entity_type(F.col("text")).alias("type"))


@query("SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'hard' WHEN count(*) <= 2 THEN 'easy' WHEN count(*) <= 4 THEN 'medium' ELSE 'hard' END AS difficulty FROM conversations GROUP BY conv_id")
def difficulty_bucket(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return turns.select("conv_id", T.difficulty(F.when(F.col("conv_id") % 5 == 0, "hard"), F.col("n")).alias("difficulty"))


# ---- numbers

@query("""
WITH s AS (SELECT p_partkey, p_size * 37 AS h, p_size * 11 + 400 AS w FROM part),
a AS (SELECT *, greatest(32, CAST(round_even(h / 32.0, 0) * 32 AS BIGINT)) AS ha, greatest(32, CAST(round_even(w / 32.0, 0) * 32 AS BIGINT)) AS wa FROM s)
SELECT p_partkey, CAST(CASE WHEN ha * wa > 1000000 THEN greatest(32, floor(CAST(floor(h / sqrt(h * w / 1000000.0)) AS BIGINT) / 32.0) * 32) WHEN ha * wa < 65536 THEN ceil(h * sqrt(65536.0 / (h * w)) / 32) * 32 ELSE ha END AS BIGINT) AS height,
    CAST(CASE WHEN ha * wa > 1000000 THEN greatest(32, floor(CAST(floor(w / sqrt(h * w / 1000000.0)) AS BIGINT) / 32.0) * 32) WHEN ha * wa < 65536 THEN ceil(w * sqrt(65536.0 / (h * w)) / 32) * 32 ELSE wa END AS BIGINT) AS width FROM a
""")
def smart_resize(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("h"), (F.col("p_size") * 11 + 400).alias("w"))
    size = N.smart_resize(F.col("h"), F.col("w"), most=1_000_000)
    return part.select("p_partkey", size.alias("s")).select("p_partkey", "s.height", "s.width")


@query("""
WITH b AS (SELECT p_partkey, p_size * 10.0 AS l, p_size * 5.0 AS t, least(1000.0, p_size * 15.0 + 60) AS r, least(1000.0, p_size * 9.0 + 80) AS o FROM part),
x AS (SELECT p_partkey, CAST(floor(l / 1000 * 1280) AS INT) AS "left", CAST(floor(t / 1000 * 720) AS INT) AS top, CAST(floor(r / 1000 * 1280) AS INT) AS "right", CAST(floor(o / 1000 * 720) AS INT) AS bottom FROM b)
SELECT * FROM x WHERE "right" - "left" >= 28 AND bottom - top >= 28
""")
def bbox_crop(spark, sf_dir):
    size = F.col("p_size")
    box = F.array(size * 10.0, size * 5.0, F.least(F.lit(1000.0), size * 15.0 + 60), F.least(F.lit(1000.0), size * 9.0 + 80))
    return read(spark, sf_dir, "part").select("p_partkey", N.box_pixels(box, F.lit(720), F.lit(1280)).alias("b")).where("b IS NOT NULL").select("p_partkey", "b.*")


_RULE = "CASE CAST(l_orderkey % 7 AS INT) " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(T.OPERATIONS)) + " END"


@query(f"""
WITH o AS (SELECT l_orderkey, {_RULE} AS rule, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, rule, round(CASE WHEN len(v) = 1 THEN v[1] WHEN rule = 'ADD' THEN list_sum(v) WHEN rule = 'SUBTRACT' THEN v[1] - list_sum(v[2:]) WHEN rule = 'MULTIPLY' THEN list_product(v)
    WHEN rule = 'DIVIDE' THEN CASE WHEN v[2] = 0 THEN 0.0 ELSE v[1] / list_product(list_filter(v[2:], lambda x: x <> 0)) END WHEN rule = 'MAX' THEN list_max(v) WHEN rule = 'MIN' THEN list_min(v) ELSE list_avg(v) END, 4) AS result FROM o
""")
def fusion_fold(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("all"))
    values = lines.select("l_orderkey", F.expr(_RULE).alias("rule"), F.transform("all", lambda x: x["l_quantity"]).alias("v"))
    return values.select("l_orderkey", "rule", F.round(N.fuse(F.col("v"), F.col("rule")), 4).alias("result"))


@query("""
SELECT l_orderkey, round(CASE WHEN count(*) <= 1 THEN 1.0 ELSE 0.6 * least(1.0, count(*) / 10) + 0.4 * count(DISTINCT l_returnflag) / count(*) END, 9) AS diversity FROM lineitem GROUP BY l_orderkey
""")
def diversity(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("entities"), F.collect_list("l_returnflag").alias("relations"))
    return lines.select("l_orderkey", F.round(N.diversity(F.col("entities"), F.col("relations")), 9).alias("diversity"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE CAST(400 + user_id % 5 AS VARCHAR) END AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def http_error_hist(spark, sf_dir):
    events = read(spark, sf_dir, "events").where("event_type = 'error'")
    error = F.when(F.col("event_id") % 3 == 0, "timed out").otherwise(F.concat(F.lit("fetch: HTTP "), (F.col("user_id") % 5 + 400).cast("string")))
    return scoring.error_histogram(error, events)


# ---- graph: regions, nations, customers, orders

_EDGES = """
    SELECT 'R' || r_regionkey AS src, 'N' || n_nationkey AS dst, 'has_nation' AS relation, 0.99::DOUBLE AS confidence FROM region JOIN nation ON r_regionkey = n_regionkey
    UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'has_customer', 0.9 + c_custkey % 10 / 100.0 FROM customer
    UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'has_supplier', 0.8 + s_suppkey % 20 / 100.0 FROM supplier
    UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'placed', 0.95::DOUBLE FROM orders
"""


def edges(spark, sf_dir) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    node = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    parts = [
        t("nation").select(node("R", "n_regionkey").alias("src"), node("N", "n_nationkey").alias("dst"), F.lit("has_nation").alias("relation"), F.lit(0.99).alias("confidence")),
        t("customer").select(node("N", "c_nationkey").alias("src"), node("C", "c_custkey").alias("dst"), F.lit("has_customer").alias("relation"), (0.9 + F.col("c_custkey") % 10 / 100.0).alias("confidence")),
        t("supplier").select(node("N", "s_nationkey").alias("src"), node("S", "s_suppkey").alias("dst"), F.lit("has_supplier").alias("relation"), (0.8 + F.col("s_suppkey") % 20 / 100.0).alias("confidence")),
        t("orders").select(node("C", "o_custkey").alias("src"), node("O", "o_orderkey").alias("dst"), F.lit("placed").alias("relation"), F.lit(0.95).alias("confidence")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, count(*) AS frequency, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS relation FROM lineitem GROUP BY 1, 2")
def neighbors(spark, sf_dir):
    claims = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return merge.frequency(claims)


@query("""
WITH c AS (SELECT l_suppkey AS src, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_partkey % 2 = 0 THEN 'Part_' ELSE 'part ' END || (l_partkey % 40) AS entity, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'd' || l_orderkey END AS description FROM lineitem)
SELECT src, replace(lower(entity), '_', ' ') AS name, arg_min(entity, ord) AS entity, coalesce(arg_min(description, ord) FILTER (WHERE description <> ''), '') AS description, count(*) AS merged, least(8, count(*)) AS n_sources FROM c GROUP BY 1, 2
""")
def neighbor_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.when(F.col("l_partkey") % 2 == 0, "Part_").otherwise("part "), (F.col("l_partkey") % 40).cast("string")).alias("entity"),
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat(F.lit("d"), "l_orderkey")).alias("description"),
        F.lit("seen").alias("evidence"), F.array(F.col("l_returnflag")).alias("sources"),
    )
    return merge.merge_candidates(rows).select("src", "name", "entity", "description", "merged", long(F.size("sources")).alias("n_sources"))


@query("""
SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY fam, confidence DESC, ord) AS BIGINT) AS rank FROM (
    SELECT c_nationkey AS src, c_custkey AS dst, CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE (c_custkey % 7) / 10.0 END AS fam, 0.9 + c_custkey % 10 / 100.0 AS confidence, c_custkey AS ord FROM customer)
""")
def edge_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 7 / 10.0).alias("familiarity"), (0.9 + F.col("c_custkey") % 10 / 100.0).alias("confidence"), F.col("c_custkey").alias("ord"))
    return graph.rank_edges(rows).select("src", "dst", long(F.col("rank")).alias("rank"))


@query("""
WITH s AS (SELECT s_nationkey AS query, s_suppkey AS ord, CAST(s_suppkey % 6 - CASE WHEN s_nationkey % 3 = 0 THEN 20 ELSE 2 END AS INT) AS score FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS n, max(score) OVER (PARTITION BY query) AS best, count(*) OVER (PARTITION BY query) AS c FROM s)
SELECT query, ord, score FROM r WHERE n = CASE WHEN best < 0 AND c > 1 THEN 2 ELSE 1 END
""")
def disambiguate(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 6 - F.when(F.col("s_nationkey") % 3 == 0, 20).otherwise(2)).cast("int").alias("score"))
    return graph.disambiguate(rows)


@query(f"""
WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE confidence >= 0.9), p(seed, last, path, depth) AS (
    SELECT 'R' || r_regionkey, 'R' || r_regionkey, 'R' || r_regionkey, 0 FROM region
    UNION ALL SELECT seed, dst, path || '>' || dst, depth + 1 FROM p JOIN e ON last = src WHERE depth < 3
) SELECT seed, path FROM p WHERE depth = 3
""")
def evidence_paths(spark, sf_dir):
    seeds = read(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("seed"))
    good = edges(spark, sf_dir).where(P.valid_edge(F.col("confidence"), F.col("relation")))
    return graph.expand_paths(seeds, good, 3).select("seed", F.array_join("nodes", ">").alias("path"))


@query(f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, relation) AS n FROM ({_EDGES}) WHERE confidence >= 0.9),
b AS (SELECT * FROM e WHERE n <= 3)
SELECT x.src AS seed, x.src || '>' || x.dst || '>' || y.dst || '>' || z.dst AS path FROM b x JOIN b y ON x.dst = y.src JOIN b z ON y.dst = z.src WHERE x.src LIKE 'R%'
""")
def evidence_beam(spark, sf_dir):
    seeds = read(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("seed"))
    good = edges(spark, sf_dir).where(P.valid_edge(F.col("confidence"), F.col("relation")))
    return graph.expand_paths(seeds, good, 3, beam=3).select("seed", F.array_join("nodes", ">").alias("path"))


@query("SELECT l_orderkey, string_agg('Level ' || (n - 1) || ' -> Level ' || n || ': ' || a || ' --[' || l_returnflag || ']--> ' || l_partkey, chr(10) ORDER BY n) AS shown FROM (SELECT *, row_number() OVER w AS n, coalesce(lag(CAST(l_partkey AS VARCHAR)) OVER w, 'O' || l_orderkey) AS a FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)) GROUP BY l_orderkey")
def path_render(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("all"))
    nodes = F.array_prepend(F.transform("all", lambda x: x["l_partkey"].cast("string")), F.concat(F.lit("O"), "l_orderkey"))
    return rows.select("l_orderkey", graph.render_path(nodes, F.transform("all", lambda x: x["l_returnflag"])).alias("shown"))


# ---- quality, reports and sets

@query("""
SELECT d.doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'rewrite' WHEN quality = 0 AND toxic = 1 THEN 'keep_model_issue' WHEN quality = 0 AND toxic = 0 THEN 'rewrite' ELSE 'keep' END AS route
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def leak_route(spark, sf_dir):
    questions = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("original_index"))
    judged = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("original_index"), (F.col("quality") == 1).alias("solved"), (F.col("toxic") == 1).alias("leaked"), (F.col("toxic") == 1).alias("model_issue"), F.lit(1).alias("ord"))
    return quality.route(questions, judged).select(F.col("original_index").alias("doc_id"), "route")


@query("""
WITH c AS (SELECT doc_id, unnest(range(0, least(5, len(string_split(text, chr(10)))))) AS i FROM documents), r AS (SELECT doc_id, i, (doc_id + i) % 3 = 0 AS critical FROM c)
SELECT doc_id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE critical), '') AS critical, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE NOT critical), '') AS redundant,
    round(avg(CASE WHEN critical THEN 0.0 ELSE 1.0 END), 6) AS redundancy_ratio, count(*) AS total FROM r GROUP BY doc_id
""")
def ablation_summary(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.lit("q").alias("question"), F.lit("gold").alias("expected"), F.split("text", "\n").alias("conditions"))
    items = quality.ablation_items(docs)
    answers = items.where((F.col("question_id") + F.col("condition_index")) % 3 != 0).select("question_id", "condition_index", F.lit("The GOLD one").alias("answer"))
    listed = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return quality.ablation_summary(quality.ablation_results(items, answers)).select(F.col("question_id").alias("doc_id"), listed("critical"), listed("redundant"), F.round("redundancy_ratio", 6).alias("redundancy_ratio"), "total")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def vqa_count_top10(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").limit(10)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def chain_topk(spark, sf_dir):
    return graph.top(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1] AS first, list(o_orderkey ORDER BY o_orderkey)[-1] AS last, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:3], ',') AS head FROM orders GROUP BY o_custkey")
def first_last_slice(spark, sf_dir):
    listed = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return listed.select("o_custkey", F.get("k", F.lit(0)).alias("first"), F.try_element_at("k", F.lit(-1)).alias("last"), F.array_join(F.transform(F.slice("k", 1, 3), lambda x: x.cast("string")), ",").alias("head"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 10")
def local_search(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id").orderBy("doc_id").limit(10)


@query("SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def federated_union(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return merge.federated({"customer": customers, "supplier": suppliers})


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text AS question, '' AS answer, CAST(0 AS BIGINT) AS n_constraints, 0.5::DOUBLE AS difficulty_score FROM documents")
def training_export(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))
    return sinks.training_export(docs).select("id", "question", "answer", long(F.size("constraints")).alias("n_constraints"), "difficulty_score")


@query("""
WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM documents),
e AS (SELECT DISTINCT lang || ' ' || source AS entity, lang, source FROM documents), n AS (SELECT entity, unnest([lang, source]) AS word FROM e)
SELECT doc_id, entity FROM w JOIN n ON w.word = n.word GROUP BY doc_id, entity
""")
def entity_in_question(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    names = docs.select(F.concat_ws(" ", "lang", "source").alias("entity")).distinct()
    return quality.entities_in(docs.select(F.col("doc_id").alias("question_id"), F.col("text").alias("question")), names).select(F.col("question_id").alias("doc_id"), "entity")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from hopweave.streaming.results import event_counts

    return event_counts(read(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"""
WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN NULL ELSE {_LETTER} END AS letter FROM conversations)
SELECT conv_id, round(avg(CASE WHEN letter IN ('A', 'B') THEN 1.0 ELSE 0.0 END), 6) AS em FROM a GROUP BY conv_id
""")
def mcq_score(spark, sf_dir):
    samples = transcripts(spark, sf_dir).select("conv_id", "output", F.array(F.lit("a"), F.lit("B")).alias("golds"), F.lit(None).cast("array<string>").alias("verdicts"), F.lit(None).cast("string").alias("error"))
    return scoring.score(samples, ["em_score_mcq"]).groupBy("conv_id").agg(F.round(F.avg("em_score_mcq"), 6).alias("em"))
