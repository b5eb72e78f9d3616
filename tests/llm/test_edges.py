"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hopweave.llm import bpe, chat, common, decontaminate, embeddings, lines, pii, quality, simhash, substrings, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ODD = [None, "", " \t\n", "one", "a\x0bb", "日本語 テキスト 😀", "x" * 20_000, LONG]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", None if i % 3 == 0 else "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def with_clashes(frame):
    """Extra columns named like the operators' own results."""
    extra = ["id", "hash", "fp", "component_id", "n_tokens", "line", "host", "key", "seed", "digits", "label2", "__x"]
    return frame.select("*", *[F.lit(f"extra {c}").alias(c) for c in extra])


RUNS = {
    "bpe": lambda s, d: bpe.token_digests(d),
    "simhash": lambda s, d: simhash.fingerprint_components(simhash.fingerprints(d)),
    "near": lambda s, d: simhash.keep_one(d),
    "lines": lambda s, d: lines.drop_boilerplate(d, "source", "text", n_lines="n", n_removed="m"),
    "pii": lambda s, d: pii.find(d, pii.fit(d)),
    "quality": lambda s, d: quality.keep_good(d, s.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")),
    "leaks": lambda s, d: decontaminate.report(d, s.createDataFrame([(1, LONG[:200]), (2, None), (3, "")], "item_id long, text string")),
    "substrings": lambda s, d: substrings.removals(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_texts(spark, name):
    frame = with_clashes(docs(spark, ODD).union(docs(spark, ODD)))
    rows = RUNS[name](spark, frame).collect()
    if name in ("bpe", "simhash", "lines", "pii", "substrings"):
        assert len(rows) == 2 * len(ODD)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name](spark, docs(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(RUNS))
def test_null_ids(spark, name):
    frame = docs(spark, ["a b c", "d e f"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert RUNS[name](spark, frame).count() <= 2


# ---- byte-level BPE


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})
    own = bpe.codec(bpe.default_vocabulary(), bpe.default_pattern())
    rng = np.random.default_rng(5)
    alphabet = list("aeiouthrns '.,\n\t 0123éß漢😀<|>") + ["ing", "  ", "'s", "tion"]
    texts = ["".join(rng.choice(alphabet, size=rng.integers(0, 60))) for _ in range(1500)] + [t or "" for t in ODD] + [" lead", "trail ", "a" * 700]
    assert own.encode_texts(texts) == [encoding.encode_ordinary(t) for t in texts]
    assert ["".join(own.decode(ids, chunk=3)) for ids in own.encode_texts(texts)] == texts
    row = bpe.token_digests(docs(spark, ["don't stop"])).first()
    ids = encoding.encode_ordinary("don't stop")
    assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_survives_dropping_its_states():
    ranks = bpe.load_ranks(bpe.default_vocabulary())
    small, large = bpe.BpeTransducer(ranks, max_states=50), bpe.BpeTransducer(ranks)
    pieces = [w.encode() for w in re.findall(r"\w+", LONG)[:300]] + [b"unbelievably", "übergröße".encode()]
    assert [small.encode(p) for p in pieces] == [list(x) for x in large.encode_many(pieces)] == [bpe.merge_by_rank(ranks, p) for p in pieces]


def test_utf8_machine_takes_any_split():
    data = "aé漢😀z".encode() + b"\xff\xe2\x82" + "x".encode()
    for cut in range(len(data) + 1):
        machine = bpe.Utf8Machine()
        assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.close() == data.decode("utf-8", "replace")


def test_round_trip_columns(spark):
    back = bpe.decode_documents(bpe.encode_documents(docs(spark, ["héllo wörld", None])))
    assert [r["decoded"] for r in back.orderBy("doc_id").collect()] == ["héllo wörld", ""]


def test_words_met_again_are_not_encoded_again(monkeypatch):
    """Full tables begin anew, but what the text goes on using is taken over."""
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 2)
    codec = bpe.Codec(bpe.default_vocabulary(), bpe.default_pattern())
    asked, own = [], codec.fst.encode_many
    monkeypatch.setattr(codec.fst, "encode_many", lambda pieces: asked.extend(pieces) or own(pieces))
    text = "x zzyx1, qwrt. zzyx1, wordes"
    first = codec.encode(text)
    asked.clear()
    assert codec.encode(text) == first == codec.encode(text) and not {b" zzyx", b" qwrt", b" wordes"} & set(asked)
    assert codec.decode_bytes(first) == text.encode()


def test_no_cycles_are_searched_while_encoding(spark):
    """A codec's objects are many and not cyclic; afterwards the worker searches again."""
    import gc

    runs = []
    noted = lambda phase, info: phase == "start" and runs.append(info)
    batch = [bpe.pa.RecordBatch.from_arrays([bpe.pa.array([k]), bpe.pa.array([" ".join(f"w{k}x{i}" for i in range(20_000))])], ["doc_id", "text"]) for k in range(2)]
    taken = []

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, function, schema: taken.append(function)

    bpe.token_digests(Docs())
    gc.callbacks.append(noted)
    try:
        rows = taken[0](iter(batch))
        assert [next(rows).num_rows for _ in batch] == [1, 1] and not runs
        assert list(rows) == [] and gc.isenabled()
    finally:
        gc.callbacks.remove(noted)


# ---- SimHash and near copies


def test_anchors_find_every_close_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, size=60, dtype=np.int64)
    near = np.concatenate([base, *[base ^ (np.int64(1) << rng.integers(0, 62, size=60)) ^ (np.int64(1) << rng.integers(0, 62, size=60)) for _ in range(4)], base[:9] ^ np.int64(-(1 << 63))])
    fps = np.unique(near)
    found = {(r["a"], r["b"]) for r in simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect()}
    expected = {(int(a), int(b)) for a in fps for b in fps if a < b and int(np.bitwise_count(a ^ b)) <= 2}
    assert found == expected and len(expected) > 200


def test_fingerprint_by_hand():
    import xxhash

    words = "A b\tc d".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).lower(), 42) for i in range(2)]
    assert simhash.fingerprint_of(simhash.shingle_hashes("A b\tc d", 3)) == hashes[0] & hashes[1]
    assert simhash.fingerprint_of(simhash.shingle_hashes("A b", 3)) == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.fingerprint_of(simhash.shingle_hashes(None, 3)) == 0


def broadcast_replicas(plan):
    """Whether a plan broadcasts what Python made of rows, whose number Spark cannot know."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        below = itertools.takewhile(lambda x: depth(x) > depth(line), lines[at + 1 :])  # noqa: B023
        if "BroadcastExchange" in line and any("MapInArrow" in x for x in below):
            return True
    return False


def test_replicas_are_not_broadcast(spark):
    """Some 60 replicas a fingerprint: 0.5 GB of documents have 14 million, which no driver holds."""
    links = simhash.fingerprint_links(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not broadcast_replicas(plan)


def test_components_beyond_one_task(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100 + i, 101 + i) for i in range(10)], "a long, b long")
    for bound in (1_000_000, 5):
        roots = {r["node"]: r["root"] for r in common.components(chain, forest_edges=bound).collect()}
        assert roots == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 11)}}


def test_components_of_few_edges_with_many_nodes(spark):
    """The last task merges all edges that are left, however many nodes they have."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        chains = spark.createDataFrame([(3 * i, 3 * i + 1) for i in range(30)] + [(3 * i + 1, 3 * i + 2) for i in range(30)], "a long, b long")
        rows = [(r["node"], r["root"]) for r in common.components(chains, forest_edges=100, forest_nodes=10).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(rows) == [(3 * i + k, 3 * i) for i in range(30) for k in (1, 2)]


@pytest.mark.parametrize("at_once", [0, simhash.PAIRS_AT_ONCE])
@pytest.mark.parametrize("hub", [0, 30, 60])
def test_near_copies_of_a_hub(spark, monkeypatch, hub, at_once):
    """Variants are near copies of the hub, not of each other: none is lost, wherever the hub's id is."""
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    base = [f"h{i}" for i in range(300)]
    texts = [list(base) for _ in range(61)]
    for i, own in enumerate(texts):
        for at in rng.choice(300, size=5, replace=False) if i != hub else []:
            own[at] = f"v{i}x{at}"
    texts = [" ".join(t) for t in texts]
    # the definition: components of all pairs that share a band and are similar
    sets = [set(simhash.shingle_hashes(t, simhash.NEAR_WORDS).tolist()) for t in texts]
    keys = [set(simhash.band_keys(simhash.shingle_hashes(t, simhash.NEAR_WORDS)).tolist()) for t in texts]
    forest = common.Forest()
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and len(sets[i] & sets[j]) >= simhash.NEAR_SIMILARITY * len(sets[i] | sets[j]):
                forest.join(i, j)
    gone = {i for i in range(len(texts)) if forest.root(i) != i}
    assert len(gone) == 60
    assert {r["doc_id"] for r in simhash.near_duplicate_groups(docs(spark, texts)).collect()} == gone


def test_near_copies_with_distant_fingerprints(spark):
    """Repeats move a fingerprint, not the set of shingles."""
    line = " ".join(f"r{i}" for i in range(8))
    own = [" ".join(f"d{k}w{i}" for i in range(300)) for k in range(6)]
    texts = [t for text in own for t in (f"{text} {line}", " ".join([text] + [line] * 1000))]
    fps = [simhash.fingerprint_of(simhash.shingle_hashes(t, simhash.NEAR_WORDS)) for t in texts]
    assert max((a ^ b).bit_count() for a, b in zip(fps[::2], fps[1::2])) > 22
    assert {r["doc_id"] for r in simhash.near_duplicate_groups(docs(spark, texts)).collect()} == {1, 3, 5, 7, 9, 11}


def test_near_copies(spark):
    words = [f"word{i}" for i in range(200)]
    close = [*words[:100], "changed", *words[101:]]
    half = [*words[:100], *[f"other{i}" for i in range(100)]]
    kept = simhash.keep_one(docs(spark, [" ".join(w) for w in (words, close, words, half)])).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 3]


def test_near_copies_broadcast_no_replicas(spark, monkeypatch):
    plans = []

    def noted(df, name, own=common.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(common, "written", noted)
    text = " ".join(f"w{i}" for i in range(100))
    kept = simhash.keep_one(docs(spark, [text, f"{text} more", "another"])).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2]
    assert sum("MapInArrow" in p for p in plans) > 2 and not any(map(broadcast_replicas, plans))


def test_near_copies_broadcast_nothing_that_grows(spark, monkeypatch):
    """Only the ids that fetch their texts may be broadcast: the prefixes of 0.6 GB took 61 MB of the driver's memory."""
    plans, own = [], common.written

    def noted(df, name):
        out = own(df, name)
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 0)
    base = [f"h{i}" for i in range(300)]
    texts = [" ".join([*base[:at], *(f"v{at}x{i}" for i in range(changed)), *base[at + changed :]]) for changed in (10, 60) for at in range(0, 300, 60)]
    assert {r["doc_id"] for r in simhash.near_duplicate_groups(docs(spark, texts)).collect()} == {1, 2, 3, 4}
    assert {"near-meetings", "near-links", "near-apart", "near-prefixes"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan and name != "near-shingles"] == []


def test_settled_keys_are_not_met_again(spark, monkeypatch):
    """Each round takes the keys that the one before left apart, with all their members."""
    read, own = [], common.written

    def noted(df, name):
        if name == "near-apart":
            read.append({f.split("/")[-2].rpartition("-")[0] for f in df.inputFiles()})
        return own(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 0)
    base = [f"h{i}" for i in range(300)]
    texts = [" ".join([*base[:at], *(f"v{at}x{i}" for i in range(changed)), *base[at + changed :]]) for changed in (10, 60) for at in range(0, 300, 60)]
    assert {r["doc_id"] for r in simhash.near_duplicate_groups(docs(spark, texts)).collect()} == {1, 2, 3, 4}
    assert len(read) > 1 and "near-meetings" in read[0]
    assert all("near-apart" in names and "near-meetings" not in names for names in read[1:])


# ---- lines, chat, urls


def test_line_ratio(spark):
    texts = [f"menu\nown {i}\n\n" for i in range(10)] + ["menu\nmenu"]
    kept = lines.drop_boilerplate(docs(spark, texts).withColumn("source", F.lit("s")), "source", "text").orderBy("doc_id").collect()
    assert [r["text"] for r in kept] == [f"own {i}\n\n" for i in range(10)] + [""]


def test_shuffled_boilerplate_equals_broadcast(spark, monkeypatch):
    frame = docs(spark, [f"a\nb {i}" for i in range(30)])
    one = {tuple(r) for r in lines.drop_boilerplate(frame, "source", "text").collect()}
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert {tuple(r) for r in lines.drop_boilerplate(frame, "source", "text").collect()} == one


EVENT = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_events_fold(spark):
    log = [
        (1, 0, 0, "delta", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, "delta", "assistant", "llo"), (1, 3, 2, "delta", "user", "more"),
        (1, 4, 1, "regenerate", "assistant", "new"), (1, 5, 1, "delta", "assistant", " one"), (1, 6, 0, "edit", "user", "hey"), (1, 7, 2, "delta", "user", "again <|im_end|>\\n"),
        (2, 0, 0, None, None, None),
    ]
    messages = chat.reconstruct(spark.createDataFrame(log, EVENT))
    assert [tuple(r) for r in messages.orderBy("conv_id", "turn").collect()] == [(1, 0, "user", "hey"), (1, 1, "assistant", "new one"), (1, 2, "user", "again <|im_end|>\\n"), (2, 0, "", "")]
    cut = chat.chunks(F.col("formatted"))
    done = chat.render(messages).select("conv_id", "formatted", chat.parse(cut).alias("turns"), chat.loss_text(cut, F.col("mask")).alias("loss")).orderBy("conv_id").collect()
    assert [tuple(t) for t in done[0]["turns"]] == [("user", "hey"), ("assistant", "new one"), ("user", "again <|im_end|>\\n")]
    assert done[0]["loss"] == "new one" and done[0]["formatted"].count("<|im_end|>") == 3


def test_chat_query_on_odd_rows(spark, tmp_path):
    """Null conversations, turns, roles and texts, ties, repeated rows, long texts, clashing columns; then no row."""
    rows = [(None, 0, "user", "a"), (1, None, "user", "first"), (1, 2, "assistant", None), (1, 2, None, "tie"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"), (2, 0, "assistant", LONG + "<|im_end|>\n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.select("*", *[F.lit("x").alias(c) for c in ("seq", "kind", "place", "part", "mask")]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    turns = {None: [("user", "a")], 1: [("user", "first"), ("", "tie"), ("assistant", ""), ("assistant", "tie"), ("assistant", "tie")], 2: [("assistant", LONG + "<|im_end|>\n")], -1: [("user", chat.HOSTILE), ("assistant", chat.HOSTILE)]}
    assert {k: (r["n_turns"], r["turns_sha256"]) for k, r in got.items()} == {k: (len(t), digest(t)) for k, t in turns.items()}
    for key, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    frame.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r["conv_id"] for r in chat.op5_chat(spark, f"{tmp_path}/none").collect()] == [-1]


def test_derived_log_really_folds(spark):
    """The log holds drafts, edits, regenerations and split texts; only the messages are left of them."""
    rows = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "answer"), (1, 2, "user", "")], "conv_id long, turn long, role string, text string")
    log = chat.event_log(rows)
    assert {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()} == {"delta": 7, "edit": 2, "regenerate": 1}
    assert log.where(F.col("text").isin(chat.DRAFT, chat.STALE)).count() == 4
    assert [(r["role"], r["text"]) for r in chat.reconstruct(log).orderBy("turn").collect()] == [("user", "hello"), ("assistant", "answer"), ("user", "")]


@pytest.mark.parametrize("text", ["<|", "<\\p", "\\", "\\b\\p<|im_start|>", "<\\|", "a\nb", "\\n"])
def test_escape_round_trip(spark, text):
    row = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("t"), chat.unescape_role(chat.escape_role(F.lit(text))).alias("r")).first()
    assert "<|" not in row["e"] and row["t"] == text == row["r"]


@pytest.mark.parametrize(("shard_keys", "size"), [(500_000, 16 << 20), (200, 16 << 20), (200, 0)])
def test_cascade_is_exact(spark, shard_keys, size):
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.Cascade(universe, bits_per_key=2, shard_keys=shard_keys, cascade_bytes=size)
    assert cascade.depth > 2
    assert cascade.listed(universe, F.col("key"), "found").where("found != listed").count() == 0


def test_urls_of_odd_pages(spark, tmp_path):
    """Null, empty and very long urls, repeated rows and ids, clashing columns; then no page."""
    listed = "http://bad.test/" + "x" * 50_000
    rows = [(1, listed), (1, listed), (2, listed + "?q"), (3, listed + "y"), (4, None), (5, ""), (None, "http://WWW.example.net/en/1"), (6, "http://a.net/x"), (7, "http://notnet/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("x").alias(c) for c in ("host", "path", "key", "shard", "listed", "flag", "rule")])
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (3, 1, None), (4, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for folder, frame in ((str(tmp_path), pages), (f"{tmp_path}/none", pages.limit(0))):
        frame.write.parquet(f"{folder}/pages.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
    got = sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in urls.op6_url_filter(spark, str(tmp_path)).collect())
    assert got == [
        (0, "www.example.net", 5, "example.net/en/", "allow"), *[(1, "bad.test", 50_001, None, "block")] * 2, (2, "bad.test", 50_001, None, "block"), (3, "bad.test", 50_002, None, "allow"),
        (4, "", 0, None, "allow"), (5, "", 0, None, "allow"), (6, "a.net", 2, "net/", "block"), (7, "notnet", 1, None, "allow"),
    ]
    assert urls.op6_url_filter(spark, f"{tmp_path}/none").count() == 0


def test_cascade_without_keys(spark):
    nothing = spark.range(5).select(F.col("id").cast("string").alias("key"), F.lit(False).alias("listed"))
    assert urls.Cascade(nothing).listed(nothing, F.col("key"), "found").where("found").count() == 0
    assert urls.Cascade(nothing.withColumn("listed", F.lit(True))).listed(nothing, F.col("key"), "found").where("found").count() == 5


@pytest.mark.parametrize(("url", "host", "path"), [("HTTP://A.Example.NET/En?x", "a.example.net", "/En"), ("x://h", "h", ""), ("nothing", "", ""), (None, "", ""), ("a://b#c/d", "b", ""), ("p://q/r://s", "q", "/r://s")])
def test_url_parts(spark, url, host, path):
    row = spark.range(1).select(urls.host_of(F.lit(url).cast("string")).alias("h"), urls.path_of(F.lit(url).cast("string")).alias("p")).first()
    assert (row["h"], row["p"]) == (host, path)


# ---- decontamination, quality, personal data, substrings, embeddings


def test_substitutions_and_big_benchmarks(spark):
    item = [f"word{i}" for i in range(40)]
    altered = ["before", *item]
    for place in (8, 20, 33):
        altered[place] = "swapped"
    texts = [" ".join(altered), " ".join(item[:6]), "Word0, " + " ".join(item[1:]) + "!", " ".join(f"other{i}" for i in range(50))]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, None)], "item_id long, text string")
    for seeds in (decontaminate.SLICE_SEEDS, 60):
        rows = {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.overlaps(docs(spark, texts), benchmark, seeds).collect()}
        assert rows == {(0, 7, 37), (0, 8, 37), (2, 7, 40), (2, 8, 40)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs(spark, texts), benchmark).collect()) == [1, 3]


def test_masks_fit_every_agreement():
    for width, masks in decontaminate.FAMILIES.items():
        for wrong in itertools.combinations(range(width), width - int(np.ceil(decontaminate.MIN_AGREEMENT * width))):
            assert any(all(m[i - at] == "0" for i in wrong if 0 <= i - at < len(m)) for m in masks for at in range(width - len(m) + 1)), (width, wrong)


def test_overlaps_at_any_place_with_any_substitutions(spark):
    item, short = [f"word{i}" for i in range(12)], [f"short{i}" for i in range(8)]
    swapped = itertools.combinations(range(12), 3)
    texts = [" ".join(["before"] * (n % 2) + ["swapped" if i in wrong else w for i, w in enumerate(item)]) for n, wrong in enumerate(swapped)]
    texts += ["before " + " ".join(short), " ".join(short)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    for seeds in (decontaminate.SLICE_SEEDS, 60):
        rows = {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.overlaps(docs(spark, texts), benchmark, seeds).collect()}
        assert rows == {*((n, 1, 9) for n in range(220)), (220, 2, 8), (221, 2, 8)}


@pytest.mark.parametrize("seeds", [decontaminate.SLICE_SEEDS, 60])
def test_short_items(spark, seeds):
    items = [[f"i{k}w{n}" for n in range(k)] for k in range(1, 8)]
    texts = [" ".join(["before", *words, "after"]) for words in items]
    altered = [" ".join(["before", *words[:2], "swapped", *words[3:], "after"]) for words in items[2:]]
    benchmark = spark.createDataFrame([(len(words), " ".join(words)) for words in items] + [(8, " "), (9, None)], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.overlaps(docs(spark, texts + altered), benchmark, seeds).collect()}
    # one word of four to seven may differ, none of fewer
    assert rows == {(k - 1, k, k) for k in range(1, 8)} | {(7 + k - 3, k, k - 1) for k in range(4, 8)}


def test_leaks_without_ids(spark):
    """Rows without an id are one document a text; rows that share an id are one document."""
    item = " ".join(f"word{i}" for i in range(15))
    frame = spark.createDataFrame([(None, item), (None, "clean"), (None, None), (3, "clean"), (3, item), (4, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["contaminated"], r["items"], r["matched"]) for r in decontaminate.report(frame, benchmark).collect())
    assert rows == [(0, False, "", 0), (0, False, "", 0), (0, True, "1", 15), (3, True, "1", 15), (4, False, "", 0)]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontaminate.drop_leaks(frame, benchmark).collect()) == [(0, ""), (0, "clean"), (4, "")]
    nothing = benchmark.limit(0)
    assert decontaminate.drop_leaks(frame, nothing).count() == 6 and decontaminate.report(frame.limit(0), benchmark).count() == 0


def test_planted_substitutions_are_found(spark):
    """Recall over planted passages that meet the rule, by words and substitutions: all of them."""
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(400)]
    for words, wrong in ((12, 3), (16, 4), (20, 5), (30, 7)):
        items = [rng.choice(vocabulary, size=words).tolist() for _ in range(60)]
        texts, meets = [], set()
        for n, item in enumerate(items):
            off = set(rng.choice(words, size=wrong, replace=False).tolist())
            around = rng.choice(vocabulary, size=rng.integers(1, 30)).tolist()
            texts.append(" ".join([*around, *(f"x{i}" if i in off else w for i, w in enumerate(item)), *around]))
            if any(sum(i + k not in off for k in range(12)) >= 9 for i in range(words - 11)):
                meets.add((n, n))
        benchmark = spark.createDataFrame([(n, " ".join(item)) for n, item in enumerate(items)], "item_id long, text string")
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs(spark, texts), benchmark).collect()}
        assert meets <= found and len(meets) > 50


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d), int(i)) for i, d in enumerate(rng.integers(0, 40, size=500) * 3 + (1 << 59))]
    frame = spark.createDataFrame(rows, "digits long, doc_id long")
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [quality.kth_largest(frame, k) for k in (1, 137, 500)] == [ordered[k - 1] for k in (1, 137, 500)]


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs_, train = spark.read.parquet(f"{folder}/documents.parquet"), labels.where("doc_id % 2 = 0")
    model = quality.Resampler(docs_, train)
    kept = model.scores.select("doc_id", model.kept(F.col("digits"), F.col("doc_id")).alias("kept")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = kept[kept.quality == 1]
    assert model.scores.select(model.kept(F.col("digits"), F.col("doc_id")).cast("int").alias("k")).agg(F.sum("k")).first()[0] == model.k
    assert good.kept.mean() > 0.97 and kept[kept.quality == 0].kept.mean() < 0.1


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
            if fine[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(2)
    for _ in range(20_000):
        text = "".join(rng.choice(list("1279a.@+ -(é"), size=rng.integers(0, 45)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("4539 1488 0343 6467, x@y.z") == [("email", 21, 26), ("card", 0, 19)]


def planted_texts(rng, n):
    """Texts with (start, end) of what is private in them, and of harmless words that look alike."""
    noise = [f"w{c}rd" for c in "aeiou"] + "the of and plain prose stands here while it goes on".split()
    hexes = lambda k: "".join(rng.choice(list("0123456789abcdef"), size=k))
    private = [
        lambda: (f'token = "{(x := hexes(40))}"', x), lambda: (f"secret: {(x := 'A9' + hexes(22) + 'x7Q')}", x), lambda: (f"password: {(x := 'p4ss' + hexes(6))}", x),
        lambda: (f"key={(x := hexes(32))}", x), lambda: (f"Dr. {(x := 'Jane ' + rng.choice(['Miller', 'Novak', 'Roux']))}", x),
    ]
    harmless = [
        lambda: "".join(rng.choice(list("123456789"), size=16)), lambda: "Licensed under CC BY-NC 4.0.", lambda: f"section {rng.integers(1, 99)}.{rng.integers(1, 9)}", lambda: f"{rng.integers(1, 12)}:30 on 2024-03-{rng.integers(10, 28)}",
        lambda: f"note: {rng.integers(2, 900)} pages", lambda: f"${rng.integers(1, 99)}.50",
    ]
    texts, spans = [], []
    for _ in range(n):
        text = " ".join(rng.choice(noise, size=12))
        if rng.random() < 0.5:
            line, value = private[rng.integers(len(private))]()
            text += " " + line
            spans.append({(text.rindex(value), text.rindex(value) + len(value))})
        else:
            text += " " + harmless[rng.integers(len(harmless))]()
            spans.append(set())
        texts.append(text + " " + " ".join(rng.choice(noise, size=6)))
    texts = [t if luhn_free(t) else "plain" for t in texts]
    return texts, [s if t != "plain" else set() for t, s in zip(texts, spans, strict=True)]


def luhn_free(text):
    return not any(kind == "card" for kind, _, _ in pii.base_spans(text))


def suspects(row):
    return {(int(s.split(":")[1]), int(s.split(":")[2])) for s in row["spans"].split(",") if s.startswith("suspect:")}


def test_precision_and_recall_of_added_spans(spark):
    texts, planted = planted_texts(np.random.default_rng(12), 600)
    found = [suspects(r) for r in pii.find(docs(spark, texts), pii.fit(docs(spark, texts))).orderBy("doc_id").collect()]
    right = sum(len(a & b) for a, b in zip(found, planted, strict=True))
    assert right >= 0.95 * sum(map(len, planted)) and right >= 0.95 * sum(map(len, found))


def test_numbers_are_not_suspect(spark):
    """Digits that fail Luhn and stand alone are left alone, also where nothing else is to be learnt from."""
    texts = [f"and {4539148803436460 + i} goes on" for i in range(1, 9) if not pii.luhn(str(4539148803436460 + i))]
    assert all(not suspects(r) for r in pii.find(docs(spark, texts), pii.fit(docs(spark, texts))).collect())


def test_personal_data_query_equals_plain_patterns(spark):
    """Counts and digest of the query over whole tables, by the patterns as they are given."""
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = pii.op3_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = plain_spans(texts[row["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert row["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert row["spans"].split(",")[: len(listed)] == (listed or row["spans"].split(",")[:0])


def test_many_spans_take_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        text = " ".join(f"a{i}@b.org {i}" for i in range(n))
        begun = time.process_time()
        assert len(list(pii.free_candidates(text, pii.base_spans(text)))) == n
        took.append(time.process_time() - begun)
    assert took[1] < 10 * took[0]


def brute_removals(texts):
    owned = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for doc, words in enumerate(owned):
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), doc)
    out = []
    for doc, words in enumerate(owned):
        gone = {j for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < doc for j in range(i, i + 50)}
        out.append((len(words), len(gone), hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("frequent", "large", "longest"), [(2_000, 2_000, 256), (2, 2_000, 256), (2_000, 1, 7)])
def test_windows_equal_brute_force(spark, monkeypatch, frequent, large, longest):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "LARGE", large)
    monkeypatch.setattr(substrings, "LONGEST", longest)
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(70)]
    phrase = "this very common phrase stands in all of them".split()
    texts = []
    for _ in range(25):
        words = [f"r{x}" for x in rng.integers(0, 10_000, size=rng.integers(0, 150))]
        at, cut = rng.integers(0, len(words) + 1), rng.integers(0, 25)
        texts.append("\n".join([*words[:at], *passage[cut:], *phrase, *words[at:]]))
    texts += [texts[3], None, " ".join(passage * 3), "again " * 300, "again " * 400]
    rows = [tuple(r)[1:] for r in substrings.removals(docs(spark, texts)).orderBy("doc_id").collect()]
    assert rows == brute_removals(texts)


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 8))
    x = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0.05, 0.1, 0.2)] + [base[:5], base[:5] * 3])
    rows = [(i, [float(v) for v in row], int(i % 20 % 3)) for i, row in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, None] + [0.0] * 6, 0), (903, [float("nan")] * 8, 0), (904, rows[0][1], None), (905, rows[0][1][:4], 0), (906, [], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame.withColumn("id", F.lit("x"))).collect()}
    unit, forest, counts = x / np.linalg.norm(x, axis=1, keepdims=True), common.Forest(), dict.fromkeys(range(len(x)), 0)
    for i in range(len(x)):
        for j in range(len(x)):
            if i != j and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98:
                counts[i] += 1
                forest.join(i, j)
    assert got == {**{i: (counts[i], forest.root(i), forest.root(i) == i) for i in counts}, **{o[0]: (0, o[0], True) for o in odd}}


def test_embeddings_that_repeat(spark):
    """Rows that share an id are one vector; null ids link with nothing; an empty table has no rows."""
    one, other = [1.0, 0.5, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, one, 0), (1, one, 0), (3, one, 0), (4, other, 0), (4, None, 0), (None, one, 0), (None, one, 0), (5, [2.0, 1.0, 0.0], 1), (6, one, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(frame).where("vec_id IS NOT NULL").collect())
    assert got == [(1, 1, 1, True), (3, 1, 1, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert [tuple(r) for r in embeddings.near_duplicates(frame).where("vec_id IS NULL").collect()] == [(None, 0, None, True)]
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, folder)
        assert after.columns == frame.columns, name
        assert after.count() <= frame.count()
        frame = after
    assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).count() == frame.count()
