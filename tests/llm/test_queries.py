"""Whole queries without SQL, and the pipeline, against brute force over the driver's tables."""

import base64
import hashlib
import math
import re
import string
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from oracle import database

import corpus_pipeline
from hopweave.llm import bpe, common, decontaminate, quality, simhash

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def table(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_fingerprint(text):
    words = words_of(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:  # the smallest number spreads along the links
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= (root[a], root[b]) != (least, least)
            root[a] = root[b] = least
    return root


def test_simhash_query(spark):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in table(spark, LARGER, "documents")}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = smallest_reachable(ids, links)
    got = sorted(tuple(r) for r in simhash.op4_simhash(spark, LARGER).select("doc_id", "fingerprint", "component_id").collect())
    assert got == [(d, f"{prints[d]:016x}", root[d]) for d in ids]
    assert len(set(root.values())) < len(ids)


def plain_tokens():
    """Fresh ids by the file of ranks and the published pattern, read here."""
    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_digests(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()


def test_bpe_query(spark):
    encoding = plain_tokens()
    want = sorted((r["doc_id"], *plain_digests(encoding, r["text"])) for r in table(spark, SF, "documents"))
    assert sorted(tuple(r) for r in bpe.op8_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def plain_buckets(text):
    words = [zlib.crc32(w.encode()) for w in words_of(text.lower() if text else "")]
    pairs = [(((a * 0x9E3779B97F4A7C15 + b) % 2**64) * 0xD6E8FEB86659FD93 % 2**64) >> 40 for a, b in zip(words, words[1:])]
    return [n % quality.BUCKETS for n in words + pairs]


def plain_resampling(docs, labels):
    """{doc_id: (log weight, kept)} by counting, weighing and sorting everything at once."""
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]}
    assert len(good) <= quality.TARGET_DOCS
    raw, target = Counter(), Counter()
    for row in docs:
        grams = plain_buckets(row["text"])
        raw.update(grams)
        if row["doc_id"] in good:
            target.update(grams)
    of = [math.fsum(c.values()) + quality.BUCKETS for c in (target, raw)]
    ratio = {b: math.log((target[b] + 1) / of[0]) - math.log((raw[b] + 1) / of[1]) for b in raw}
    weight = {r["doc_id"]: math.fsum(ratio[b] for b in plain_buckets(r["text"])) for r in docs}

    def key(doc_id):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", quality.SEED), 42)
        uniform = ((xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed) >> 11) + 0.5) / 2**53
        return weight[doc_id] - math.log(-math.log(uniform))

    marks = [r["quality"] for r in labels if r["quality"] is not None]
    drawn = sorted(weight, key=lambda d: (-key(d), d))[: round(sum(marks) / len(marks) * len(docs))]
    return {d: (w, d in set(drawn)) for d, w in weight.items()}


def test_quality_query(spark):
    want = plain_resampling(table(spark, SF, "documents"), table(spark, SF, "labels"))
    got = {r["doc_id"]: (r["log_weight"], r["kept"]) for r in quality.op9_quality(spark, SF).collect()}
    assert {d: k for d, (_, k) in got.items()} == {d: k for d, (_, k) in want.items()}
    assert all(got[d][0] == pytest.approx(want[d][0], abs=2e-6) for d in want)


def plain_near_groups(docs):
    """{doc_id: smallest doc_id of its group} over all pairs of word 5-shingle sets at 0.8 or more."""
    sets, holders = {}, defaultdict(list)
    for row in docs:
        words = words_of(row["text"])
        sets[row["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for shingle in sets[row["doc_id"]]:
            holders[shingle].append(row["doc_id"])
    shared = Counter((a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[i + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [d for d, s in sets.items() if not s]
    return smallest_reachable(sorted(sets), links + list(zip(empty, empty[1:])))


def test_near_dedup_stage_recall(spark):
    """Nothing goes that brute force keeps; of what it removes at least nine in ten go."""
    root = plain_near_groups(table(spark, LARGER, "documents"))
    gone = {d for d in root if root[d] != d}
    kept = {r["doc_id"] for r in simhash.keep_one(common.table(spark, LARGER, "documents")).select("doc_id").collect()}
    found = set(root) - kept
    assert gone and found <= gone
    print(f"near-dedup removes {len(found)} of {len(gone)}")
    assert len(found) >= 0.9 * len(gone)


def plain_lines(docs):
    pages, holding = Counter(), Counter()
    for row in docs:
        host = row["source"] or ""
        pages[host] += 1
        holding.update({(host, bare) for line in (row["text"] or "").split("\n") if (bare := line.strip(" \t\r"))})
    often = {(h, b) for (h, b), n in holding.items() if n >= 3 and n > 0.05 * pages[h]}
    out = []
    for row in docs:
        if row["text"] is not None:
            kept = [line for line in row["text"].split("\n") if (row["source"] or "", line.strip(" \t\r")) not in often]
            row = {**row, "text": "\n".join(kept)}
        out.append(row)
    return out


def test_pipeline(spark, tmp_path):
    """run() against the five stages done one after another by brute force."""
    docs = table(spark, SF, "documents")
    drawn = plain_resampling(docs, table(spark, SF, "labels"))
    docs = plain_lines([r for r in docs if drawn[r["doc_id"]][1]])
    root = plain_near_groups(docs)
    docs = [r for r in docs if root[r["doc_id"]] == r["doc_id"]]
    con = database(SF)
    con.execute("CREATE OR REPLACE TABLE documents_left (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents_left VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in docs])
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM documents_left")
    clean = {r[0] for r in con.sql(f"SELECT doc_id FROM ({decontaminate.SQL['op1_decontamination']}) WHERE NOT contaminated").fetchall()}
    encoding = plain_tokens()
    want = sorted((r["doc_id"], *plain_digests(encoding, r["text"])) for r in docs if r["doc_id"] in clean)
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(tuple(r) for r in rows) == want
    assert 0 < len(want) < len(drawn)
