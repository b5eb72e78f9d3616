"""Byte-level BPE encoding and decoding (operator 8).

Encoding compiles the merge ranks into a lazily determinised finite-state
transducer (:class:`BpeTransducer`).  The underlying nondeterministic machine
reads bytes through the vocabulary's trie and guesses where a token ends; a
guess is admissible when the new token and its predecessor are *stable*
together, i.e. merging their joined bytes by rank gives back exactly these two
tokens.  A byte string has exactly one segmentation whose neighbours are all
stable, the one rank-ordered merging finds, so the subset construction carries
a handful of hypotheses: those still inside a token, which is at most the longest token's
length of lookahead, and the one that ends here.  Each state therefore names
the token with which the text read so far ends, and a token is certain once
the hypotheses that began before its end have died.  States and transitions
are created when first taken, kept under a bound and dropped when it is
reached (only speed depends on them).

Decoding looks token bytes up and feeds them to :class:`Utf8Machine`, an
incremental UTF-8 automaton that accepts any chunking of the byte stream.

Defined results: a null text is the empty text; the empty text has no token
and its digests are those of the empty string; texts of any length are encoded
whole; repeated rows give repeated results; other columns of the input, of any
name, are ignored by the query and kept by :func:`encode_documents`.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import give_back

#: States kept before the lazily built part is dropped; each has an arc of 4 bytes for every byte value met.
MAX_STATES = 120_000
#: Pairs of tokens whose stability is remembered.
MAX_PAIRS = 500_000
#: Chunks (a word with the white space before it) whose ids are remembered.
MAX_CHUNKS = 200_000
#: Marks that are a piece of their own at the end of a word of letters.
PUNCTUATION = ".,;:!?"
#: Text handed to Python at once, in rows.
BATCH_ROWS = 512
#: From how many remaining tokens on a hypothesis remembers its predecessor, not its choices.
FEW_TOKENS = 12
#: A rank after all others.
NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_by_rank(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """Plain rank-ordered merging of a short byte string: the definition."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(
            ((rank, i) for i in range(len(parts) - 1) if (rank := ranks.get(parts[i] + parts[i + 1])) is not None),
            default=None,
        )
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class BpeTransducer:
    """Transducer from the bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.max_states = max_states
        # trie: one dict per node, its token id under the key -1 and, where
        # they are few, the ids of all tokens from here on under -2
        self.root: dict = {}
        for token, rank in ranks.items():
            node = self.root
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = rank
        self._list_few(self.root)
        self._stable: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _list_few(self, node: dict) -> tuple[int, ...] | None:
        found: tuple[int, ...] | None = (node[-1],) if -1 in node else ()
        for key in [k for k in node if k >= 0]:
            below = self._list_few(node[key])
            found = None if found is None or below is None or len(found) + len(below) > FEW_TOKENS else found + below
        if found is not None:
            node[-2] = found
        return found

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        #: per state its hypotheses (id of the last token or else the tokens
        #: it may still become, trie node reached since its start)
        self.open: list[list] = []
        #: per state the token that ends what was read, or -1
        self.token = np.full(1024, -1, np.int32)
        #: per state and byte the next state, or -1 where not yet asked for; bytes get a column when first met
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.arcs = np.full((1024, 32), -1, np.int32)
        self._state([(-1, None, self.root)])

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for a byte."""
        known = self._halves.get(token, False)
        if known is False:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], NEVER), i))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether merging never crosses the border between two tokens.

        Undoes the later of the two last merges again and again and looks
        whether the parts that then meet would have merged before it.
        """
        key = left << 32 | right
        known = self._stable.get(key)
        if known is not None:
            return known
        rank, text, halves, before = self.ranks.get, self.tokens, self._halves, NEVER
        a, b, known = left, right, True
        while True:
            joined = rank(text[a] + text[b])
            if joined is not None and joined < before:
                known = False
                break
            # the merge that is undone is the later one; at a tie the left side merged first
            a_parts = halves[a] if a in halves else self.halves(a)
            b_parts = halves[b] if b in halves else self.halves(b)
            if a_parts and (not b_parts or a > b):
                before, a = a, a_parts[1]
            elif b_parts:
                before, b = b + 1, b_parts[0]
            else:
                break
        if len(self._stable) >= MAX_PAIRS:
            self._stable.clear()
        self._stable[key] = known
        return known

    def _begun(self, last: int, node: dict) -> tuple | None:
        """The hypothesis that a token begun after ``last`` has come to ``node``.

        Where few tokens are left, only which of them are stable after
        ``last`` matters: states with the same answer are one, and a
        hypothesis without any is dead.
        """
        few = node.get(-2)
        if few is None:
            return last, None, node
        if last >= 0:
            stable, known, left = self.stable, self._stable.get, last << 32
            few = tuple([t for t in few if (stable(last, t) if (k := known(left | t)) is None else k)])
        return (-1, few, node) if few else None

    def _state(self, hypotheses: list) -> int:
        key = tuple([(last, few, id(node)) for last, few, node in hypotheses])
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.open)
            self.open.append(hypotheses)
            if number == len(self.token):
                self.token = np.concatenate([self.token, np.full(number, -1, np.int32)])
                self.arcs = np.concatenate([self.arcs, np.full_like(self.arcs, -1)])
            for last, few, node in hypotheses:
                token = node.get(-1, -1)
                if token >= 0 and (token in few if few is not None else last < 0 or self.stable(last, token)):
                    self.token[number] = token
                    break
        return number

    def meet(self, data: np.ndarray) -> np.ndarray:
        """The columns of bytes; new bytes get the next ones."""
        for byte in np.unique(data[self.column[data] < 0]).tolist():
            if self.columns == self.arcs.shape[1]:
                self.arcs = np.concatenate([self.arcs, np.full_like(self.arcs, -1)], axis=1)
            self.column[byte] = self.columns
            self.columns += 1
        return self.column[data]

    def step(self, state: int, byte: int) -> int:
        """Makes the arc of a state for a byte."""
        grown = []
        for last, few, node in self.open[state]:
            longer = node.get(byte)
            if longer is None:
                continue
            if few is None:
                if begun := self._begun(last, longer):
                    grown.append(begun)
            elif left := tuple([t for t in few if t in longer[-2]]):
                grown.append((-1, left, longer))
        token = int(self.token[state])
        if token >= 0 and (first := self.root.get(byte)) is not None and (begun := self._begun(token, first)):
            grown.append(begun)
        if not grown:
            raise ValueError("no token for a byte: the vocabulary lacks single bytes")
        after = self._state(grown)
        self.arcs[state, self.column[byte]] = after
        return after

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.open) >= self.max_states:
            self._reset()
        state, ends = 0, []
        columns = self.meet(np.frombuffer(piece, np.uint8)).tolist()
        for byte, column in zip(piece, columns, strict=True):
            after = int(self.arcs[state, column])
            state = after if after >= 0 else self.step(state, byte)
            ends.append(int(self.token[state]))
        out, at = [], len(ends)
        while at > 0:
            token = ends[at - 1]
            if token < 0:
                return merge_by_rank(self.ranks, piece)
            out.append(token)
            at -= len(self.tokens[token])
        out.reverse()
        return out

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many pieces, which all take their next byte at once."""
        found: list[tuple[int, ...] | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        ranks = self.ranks
        for i, piece in enumerate(pieces):
            whole = ranks.get(piece)
            if whole is not None:
                found[i] = (whole,)
            elif len(piece) > 256:
                found[i] = tuple(self.encode(piece))
            else:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(i)
        if len(self.open) >= self.max_states:
            self._reset()
        for power, members in classes.items():
            width = 1 << power
            for at in range(0, len(members), 1 << 15):
                some = members[at : at + (1 << 15)]
                self._encode_class([pieces[i] for i in some], width, some, found)
        return found

    def _encode_class(self, pieces: list[bytes], width: int, places: list[int], found: list) -> None:
        data = np.array(pieces, dtype=f"S{width}").view(np.uint8).reshape(len(pieces), width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        data, size = data[order], size[order]
        columns = self.meet(data)
        ends = np.empty((width, len(pieces)), np.int32)
        state = np.zeros(len(pieces), np.int32)
        for j in range(int(size[0])):
            n = int(np.searchsorted(-size, -j, side="left"))  # those longer than j
            now, byte, column = state[:n], data[:n, j], columns[:n, j]
            after = self.arcs[now, column]
            missing = after < 0
            if missing.any():
                for key in np.unique(now[missing].astype(np.int64) << 8 | byte[missing]).tolist():
                    self.step(key >> 8, key & 255)
                after = self.arcs[now, column]
            state[:n] = after
            ends[j, :n] = self.token[after]
        # backwards over the tokens that end at each border
        at, rows, steps = size.copy(), np.arange(len(pieces)), []
        while True:
            token = np.where(at > 0, ends[at - 1, rows], -2)
            if (token == -2).all():
                break
            steps.append(token)
            at = np.where(token >= 0, at - self.lengths[token], 0)
        table = np.stack(steps[::-1], axis=1).tolist()
        for place, row in zip(order.tolist(), table, strict=True):
            if -1 in row:
                found[places[place]] = tuple(merge_by_rank(self.ranks, pieces[place]))
            else:
                found[places[place]] = tuple(row[row.count(-2) :] if row[0] == -2 else row)


class Utf8Machine:
    """Incremental UTF-8 decoder: any split of the bytes gives the same text.

    Ill-formed sequences become U+FFFD per maximal ill-formed prefix.  The
    state is (code point so far, continuation bytes due, next byte's range).
    """

    def __init__(self) -> None:
        self.code, self.due, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        """Characters completed by these bytes; whole well-formed runs are taken at once."""
        if self.due:
            at = self.due  # the bytes that may end the open character
            return self._bytes(data[:at]) + (self.feed(data[at:]) if len(data) > at else "")
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if byte >= 0xC0:
                cut -= back
                break
            if byte < 0x80:
                break
        try:
            return data[:cut].decode("utf-8") + self._bytes(data[cut:])
        except UnicodeDecodeError:
            return self._bytes(data)

    def _bytes(self, data: bytes) -> str:
        out: list[str] = []
        for byte in data:
            if self.due:
                if self.low <= byte <= self.high:
                    self.code = self.code << 6 | byte & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.code))
                    continue
                self.due, self.low, self.high = 0, 0x80, 0xBF
                out.append("�")
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.code, self.due = byte & 0x1F, 1
            elif 0xE0 <= byte <= 0xEF:
                self.code, self.due = byte & 0x0F, 2
                self.low = 0xA0 if byte == 0xE0 else 0x80
                self.high = 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.code, self.due = byte & 0x07, 3
                self.low = 0x90 if byte == 0xF0 else 0x80
                self.high = 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.due, self.low, self.high = self.due, 0, 0x80, 0xBF
        return "�" if left else ""


#: White space that is no plain space may lie on both sides of a split at a
#: space; Python's class is wider than the pattern's, which is the safe side.
_UNSAFE = re.compile(r"\s |^\s")


class Codec:
    """Encodes and decodes whole texts with one vocabulary and pattern.

    ``words`` and ``bare`` remember the ids of recent words and pieces.  Once
    they hold MAX_CHUNKS entries, the next batch begins them anew; ``older``
    has the words of before, of which those met again are taken over.
    """

    def __init__(self, vocabulary: str, pattern: str):
        self.fst = BpeTransducer(load_ranks(vocabulary))
        self.pieces = regex.compile(pattern).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text.

        No piece of the pattern reaches from a character that is no white
        space over a following space, so most texts are cut at single spaces
        and a word's ids, with the space before it, are remembered; other
        texts are cut by the pattern as a whole.
        """
        if len(self.words) > MAX_CHUNKS:
            self.older, self.words = self.words, {}
        if len(self.bare) > MAX_CHUNKS:
            self.bare = {}
        words, bare = self.words, self.bare
        cut: list[tuple[list[str], list[str]]] = []  # pieces, then words that follow a space
        for text in texts:
            if not text:
                cut.append(([], []))
            elif _UNSAFE.search(text) or text[-1] == " ":
                cut.append((self.pieces(text), []))
            else:
                first, *rest = text.split(" ")
                cut.append((self.pieces(first), rest))
        new_words = set().union(*(rest for _, rest in cut)).difference(words)
        if older := self.older:
            met = new_words.intersection(older)
            words.update(zip(met, map(older.__getitem__, met), strict=True))
            new_words -= met
        new_bare = set().union(*(pieces for pieces, _ in cut)).difference(bare)
        parts: list[list[str]] = list(map(self._parts, new_words))
        wanted = new_bare.union(chain.from_iterable(parts))
        known = {piece: bare[piece] for piece in wanted.intersection(bare)}
        wanted = list(wanted.difference(bare))
        known.update(zip(wanted, self.fst.encode_many([p.encode("utf-8", "surrogatepass") for p in wanted]), strict=True))
        for piece in new_bare:
            bare[piece] = known[piece]
        for word, own in zip(new_words, parts, strict=True):
            words[word] = known[own[0]] if len(own) == 1 else tuple(chain.from_iterable(map(known.__getitem__, own)))
        out = []
        for pieces, rest in cut:
            ids = list(chain.from_iterable(map(bare.__getitem__, pieces)))
            ids.extend(chain.from_iterable(map(words.__getitem__, rest)))
            out.append(ids)
        return out

    def _parts(self, word: str) -> list[str]:
        """The pieces of a word with one space before it."""
        if word.isalpha():
            return [" " + word]
        if word[-1] in PUNCTUATION and word[:-1].isalpha():
            return [" " + word[:-1], word[-1]]
        return self.pieces(" " + word)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.fst.tokens.__getitem__, ids))

    def decode(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Streams the text: each chunk of ids gives the characters complete so far."""
        machine, ids, tokens = Utf8Machine(), list(ids), self.fst.tokens
        for at in range(0, len(ids), chunk):
            yield machine.feed(b"".join(map(tokens.__getitem__, ids[at : at + chunk])))
        yield machine.close()


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """One codec per Python worker; built from the vocabulary file's path."""
    return Codec(vocabulary, pattern)


def _pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, max(1, batch.num_rows), BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def encode_documents(docs: DataFrame, text: str = "text", ids: str = "token_ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the array column ``ids`` (replacing one of that name) with the token ids of ``text``."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    @F.pandas_udf("array<int>")
    def encoded(texts):
        return pd.Series(codec(vocabulary, pattern).encode_texts([t or "" for t in texts]))

    return docs.withColumn(ids, encoded(F.col(text)))


def decode_documents(docs: DataFrame, ids: str = "token_ids", text: str = "decoded", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``text``: the decoded string of an array of token ids (null: empty)."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    @F.pandas_udf("string")
    def decoded(arrays):
        decode = codec(vocabulary, pattern).decode
        return arrays.map(lambda a: "".join(decode([] if a is None else a)))

    return docs.withColumn(text, decoded(F.col(ids)))


def token_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: n_tokens, digest of its ids, and digest of their decoding.

    Ids stay inside the task; only the digests leave it.  A task builds its
    own codec and lets go of it: workers serve other operators' tasks too.
    Nothing here is cyclic, so no cycles are looked for among a codec's many
    objects until the task is done.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = gc.isenabled()
        gc.disable()
        try:
            own = Codec(vocabulary, pattern)
            decimal = {i: str(i) for i in own.fst.tokens}
            for whole in batches:
                for batch in _pieces_of(whole):
                    counts, encoded, decoded = [], [], []
                    for ids in own.encode_texts([t or "" for t in batch.column(1).to_pylist()]):
                        counts.append(len(ids))
                        encoded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                        back = hashlib.sha256()
                        for part in own.decode(ids):
                            back.update(part.encode("utf-8"))
                        decoded.append(back.hexdigest())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
            del own, decimal
        finally:
            if searched:
                gc.enable()
        give_back()

    return source.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
#: Merging by rank is iterative: not expressible in SQL; tests compare with the tiktoken library.
SQL: dict[str, str] = {}
