"""Personal data by weak supervision (operator 3).

Base spans (email, ip, card, phone) are matched exactly.  Elsewhere three
sorts of words are candidates: those that hold a digit or an at sign, values
that follow an announcing word and a colon or equals sign, and capitalised
words after a title.  Five labelers vote yes, no or abstain on each: the
pattern of the word, gazetteers of announcing and harmless words and titles,
the context, how often letters and digits alternate, and whether it is made of
natural letters or of none.  Expectation-maximisation estimates how reliable
each labeler is from how often vote patterns occur over the whole corpus; its
posteriors train a logistic span classifier on features of the word and its
place, which adds spans of the kind ``suspect``.

The driver sees counts of (votes, features), at most 3^5 * 2^8 rows.

Matching is linear in the text: digit runs and at signs are found first and
patterns are applied where they can begin.

Defined results: null and empty texts have no span; texts of any length are
searched whole; touching matches are separate; offsets are code points, ends
exclusive; rows that repeat are searched each; without candidates nothing is
added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import in_batches, table

KINDS = ("email", "ip", "card", "phone")
ADDED = "suspect"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches of a text, by kind as listed, then by start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        free = 0  # the end of the last match
        for match in _DOMAIN.finditer(text):
            start = match.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < match.start():
                found.append(("email", start, match.end()))
                free = match.end()
    if _DIGITS.search(text) is None:
        return found
    if "." in text:
        free = 0
        for run in _DIGITS.finditer(text):
            if run.start() >= free and (match := _IP.match(text, run.start())):
                free = match.end()
                if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.groups()):
                    found.append(("ip", match.start(), match.end()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", match.start(), match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= sum(map(len, _DIGITS.findall(match.group()))) <= 15:
                found.append(("phone", match.start(), match.end()))
    return found


# Words that announce a private value, words that announce a harmless number, titles of people.
ANNOUNCING = frozenset("account api apikey bearer credential iban key login passport passwd password passwort pin pwd secret ssn token username".split())
HARMLESS = frozenset("art article by by-nc by-sa cc chapter chapitre figure gpl kapitel license page section seite table version volume".split())
TITLES = ("Dr", "Frau", "Herr", "Mme", "Mr", "Mrs", "Ms", "Prof", "Señor", "Señora")
_PUNCTUATION = ".,;:!?\"'()[]{}<>|#%&*$"
_YES, _NO, _ABSTAIN = 1, 0, 2
_MARKED = re.compile(r"([A-Za-z]+)[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"']+)")
_NAMED = re.compile(rf"\b(?:{'|'.join(TITLES)})\b\.?[ ]((?!\d)[^\W_]\w+(?: (?!\d)[^\W_]\w+)?)")
_NUMERIC = re.compile(r"[^\w@]*[0-9][0-9.,:/+()-]*[^\w@]*")
_SECRET = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=-]{12,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_ALTERNATIONS = re.compile(r"[0-9](?=[^\W\d_])|[^\W\d_](?=[0-9])")
LABELERS = 5
FEATURES = 8


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether a title precedes) of the candidates of a text, in order; none overlap."""
    found: dict[int, tuple[int, bool]] = {}
    marked: dict[int, int] = {}
    free = 0
    for match in re.finditer(r"[0-9@]", text):
        if match.start() < free:
            continue
        start = end = match.start()
        while start > free and not text[start - 1].isspace():
            start -= 1
        gap = _SPACE.search(text, end)
        free = end = gap.start() if gap else len(text)
        word = text[start:end]
        bare = word.strip(_PUNCTUATION)
        if bare:
            at = start + len(word) - len(word.lstrip(_PUNCTUATION))
            found[at] = (at + len(bare), False)
    if ":" in text or "=" in text:
        for match in _MARKED.finditer(text):
            if match[1].lower() in ANNOUNCING and (bare := match[2].strip(_PUNCTUATION)):
                at = match.start(2) + len(match[2]) - len(match[2].lstrip(_PUNCTUATION))
                marked[at] = at + len(bare)
    for match in _NAMED.finditer(text):
        if all(w[0].isupper() for w in match[1].split(" ")):
            found.setdefault(match.start(1), (match.end(1), True))
    spans: list[tuple[int, int, bool]] = []
    values = sorted(marked.items())
    at = 0
    for start, (end, named) in sorted(found.items()):
        while at < len(values) and values[at][1] <= start:
            at += 1
        beside = at == len(values) or values[at][0] >= end
        if beside and (not spans or start >= spans[-1][1]):
            spans.append((start, end, named))
    return sorted([*spans, *((a, b, False) for a, b in values)])


def judge(text: str, start: int, end: int, named: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(votes of the labelers, features) of a candidate."""
    word, before = text[start:end], text[max(0, start - 40) : start]
    words = [w.strip(_PUNCTUATION + "=") for w in before.lower().split()[-3:]]
    announced, harmless = any(w in ANNOUNCING for w in words), any(w in HARMLESS for w in words)
    mark = before.rstrip(" \t\"'")[-1:] in ("=", ":")
    quoted = before[-1:] in ('"', "'") and text[end : end + 1] == before[-1:]
    numeric, secret = _NUMERIC.fullmatch(word) is not None, _SECRET.fullmatch(word) is not None
    runs = [len(m) for m in _LETTERS.findall(word)]
    alternations = len(_ALTERNATIONS.findall(word))
    votes = (
        _YES if secret or "@" in word else _NO if numeric else _ABSTAIN,
        _YES if announced or named else _NO if harmless else _ABSTAIN,
        _YES if mark or quoted or named else _NO,
        _YES if alternations >= 4 else _NO if alternations <= 1 and not named else _ABSTAIN,
        _YES if len(word) >= 12 and runs and max(runs) <= 6 else _NO if not runs else _ABSTAIN,
    )
    features = (len(word) > 7, len(word) > 15, bool(runs) and alternations > 0, numeric, announced, mark, quoted, named)
    return votes, tuple(map(int, features))


def _code(votes: tuple[int, ...], features: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v
    for f in features:
        code = code * 2 + f
    return code


def _decode(code: int) -> tuple[list[int], list[int]]:
    features = [code >> (FEATURES - 1 - i) & 1 for i in range(FEATURES)]
    code >>= FEATURES
    return [code // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)], features


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (posterior of each, P(vote | class) by labeler, share of private ones).

    The first tables say that labelers are right more often than wrong; they
    stay in the estimate with a tenth of the weight of the rows, so a class
    that the corpus lacks is not made up.
    """
    share = 0.3
    prior = np.full((LABELERS, 2, 3), 0.1)
    prior[:, 0, _NO], prior[:, 1, _YES], prior[:, :, _ABSTAIN] = 0.6, 0.6, 0.3
    tables, weight = prior.copy(), 1 + 0.1 * counts.sum()
    for _ in range(rounds):
        logs = np.stack([np.log([1 - share, share][c]) + sum(np.log(tables[i, c, votes[:, i]]) for i in range(LABELERS)) for c in (0, 1)])
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        share = float(np.clip((posterior * counts).sum() / counts.sum(), 0.01, 0.99))
        for c, mass in ((0, (1 - posterior) * counts), (1, posterior * counts)):
            for i in range(LABELERS):
                seen = np.bincount(votes[:, i], weights=mass, minlength=3) + weight * prior[i, c]
                tables[i, c] = seen / seen.sum()
    return posterior, tables, share


def train(features: np.ndarray, posterior: np.ndarray, counts: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the intercept."""
    x = np.column_stack([features, np.ones(len(features))]).astype(float)
    weights, mass = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) - posterior
        weights -= 4.0 * (x.T @ (error * mass) + 1e-4 * weights)
    return weights


def free_candidates(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """The candidates of a text that touch none of its base spans; both lists are walked once."""
    taken = sorted((a, b) for _, a, b in spans)
    at = reach = 0
    for start, end, named in candidates(text):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            yield start, end, named


def fit(docs: DataFrame) -> np.ndarray:
    """The span classifier's weights, from all candidates of ``docs`` (text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for start, end, named in free_candidates(text, base_spans(text)):
                        seen[_code(*judge(text, start, end, named))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    parts = docs.select("text").mapInArrow(in_batches(counted, 512), "code long, n long")
    rows = sorted((r["code"], r["n"]) for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect())
    if not rows:
        return np.zeros(FEATURES + 1) - 1.0
    decoded = [_decode(code) for code, _ in rows]
    votes, features = np.array([v for v, _ in decoded]), np.array([f for _, f in decoded])
    counts = np.array([n for _, n in rows], float)
    posterior, _, _ = estimate(votes, counts)
    return train(features, posterior, counts)


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per document (doc_id, text) the base counts, the base digest and all spans."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, every = [], [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text or "")
                own = Counter(kind for kind, _, _ in spans)
                counts.append([own[kind] for kind in KINDS])
                listed = [f"{kind}:{start}:{end}" for kind, start, end in spans]
                digests.append(hashlib.sha256(",".join(listed).encode()).hexdigest())
                for start, end, named in free_candidates(text or "", spans):
                    _, features = judge(text, start, end, named)
                    if np.dot(weights, [*features, 1]) > 0:
                        listed.append(f"{ADDED}:{start}:{end}")
                every.append(",".join(listed))
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(numbers[:, i]) for i in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbers = ", ".join(f"n_{kind} long" for kind in KINDS)
    return source.mapInArrow(in_batches(searched, 512), f"doc_id long, {numbers}, base_sha256 string, spans string")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


QUERIES = {"op3_pii": op3_pii}
#: Offsets of matches and a trained classifier are beyond SQL: tests compare with plain patterns.
SQL: dict[str, str] = {}
