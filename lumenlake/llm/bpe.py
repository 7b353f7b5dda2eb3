"""BPE encoding and decoding by a tokenization automaton.

The merges of a byte-level vocabulary are compiled, one *merge gadget* after the
other, into a deterministic automaton whose arcs are labelled with tokens and
which accepts exactly the token sequences that BPE produces.  It starts as one
state with a loop for every byte.  The gadget of the i-th merge (u, v) -> uv

* takes the state s that all u-arcs enter and makes a copy s' that lacks the arc v,
* lets the u-arcs enter s' instead (u followed by v would have been merged),
* adds, beside every u-arc, an arc uv to the state that v led to from s.

All arcs with one label enter one state, so a state is named by the token read
last, and a gadget stores one removed arc with its time: a copy keeps what its
original had lost until then, and an arc uv is there where the arc u was there
when uv was made.  ``Automaton.arc`` reads that; answers are kept as a transition
table.

A pre-split word is run through the table: for each end position exactly one
token leads on from a reachable state, as each prefix has one tokenization.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.shared import kept, map_arrow

#: How the byte-level tokenizer splits text into words (fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose tokens a worker keeps; the store is emptied when it is full.
KEPT_WORDS = 300_000
#: Transitions that a worker keeps.
KEPT_ARCS = 200_000
#: Bytes of text in an output batch.
BATCH_BYTES = 4 << 20


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Deterministic automaton of a list of merges; states and labels are token ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        chars = _byte_chars()
        self.special = special
        self.labels = {i: bytes(chars[c] for c in token) for token, i in vocab.items()}
        for text, i in special.items():
            self.labels[i] = text.encode()
        self.lengths = {i: len(label) for i, label in self.labels.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.labels}
        # all labels behind each other: where each begins, its length, the bytes
        in_order = [self.labels.get(i, b"") for i in range(max(self.labels) + 1)]
        length = np.array([len(label) for label in in_order], np.int64)
        self.tape = np.cumsum(length) - length, length, np.frombuffer(b"".join(in_order), np.uint8)
        self.bytes_ids = {label[0]: i for i, label in self.labels.items() if len(label) == 1}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
        self.rows: dict[int, dict[int, bool]] = {}
        self.known = 0
        # Labels by their bytes from last to first: where a word's prefix ends, the tokens that end there.
        self.ends: dict = {}
        for i in self.made.keys() | self.bytes_ids.values():
            node = self.ends
            for byte in reversed(self.labels[i]):
                node = node.setdefault(byte, {})
            node[-1] = i

    def _gadget(self, u: int, v: int, uv: int, time: int) -> None:
        self.removed.setdefault((u, v), time)
        if uv not in self.made:
            self.left[uv], self.right[uv], self.made[uv] = u, v, time

    def arc(self, state: int, token: int) -> bool:
        """Whether the state after ``state`` has an arc ``token``."""
        removed, made, left, right = self.removed, self.made, self.left, self.right
        then, origin = 1 << 60, state
        while origin is not None:
            # the state's own losses until `then`, when it was copied from for a longer token
            when, label = 1 << 60, token
            while label is not None:
                lost = removed.get((origin, label))
                if lost is not None and lost < then and lost <= when:
                    return False
                when, label = made.get(label, -1), left.get(label)
            then, origin = made.get(origin, -1), right.get(origin)
        return True

    def run(self, word: bytes) -> list[int]:
        """The tokens of a pre-split word."""
        rows, ends = self.rows, self.ends
        if self.known > KEPT_ARCS:
            rows.clear()
            self.known = 0
        states: list[int] = [-1]
        here: list[dict[int, bool] | None] = [None]  # the transition row of the state at each position; all arcs leave the first
        for end in range(1, len(word) + 1):
            node, at = ends, end
            while True:
                at -= 1
                node = node.get(word[at])
                if node is None:
                    raise ValueError("a byte has no token")
                token = node.get(-1)
                if token is not None:
                    row = here[at]
                    if row is None:
                        break
                    ok = row.get(token)
                    if ok is None:
                        ok = row[token] = self.arc(states[at], token)
                        self.known += 1
                    if ok:
                        break
            states.append(token)
            row = rows.get(token)
            if row is None:
                row = rows[token] = {}
            here.append(row)
        out, at, lengths = [], len(word), self.lengths
        while at:
            token = states[at]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def accepts(self, tokens: list[int]) -> bool:
        return all(self.arc(a, b) for a, b in zip(tokens, tokens[1:], strict=False))


def compiled(text: bytes) -> Automaton:
    """The automaton of a byte-level BPE tokenizer file's contents (its merges, vocabulary and added tokens)."""
    spec = json.loads(text)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Automaton(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})


class _Words(dict):
    """Packed ids of words, filled by the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = b"".join(map(self.automaton.packed.__getitem__, self.automaton.run(word.encode())))
        self[word] = ids
        return ids


class Codec:
    """Encodes whole texts to packed little-endian unsigned 32-bit ids and back."""

    def __init__(self, text: bytes):
        self.automaton = kept(("bpe", len(text), hash(text)), lambda: compiled(text))
        self.words = _Words(self.automaton)
        self.find = regex.compile(PATTERN).findall
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.special = {t: i.to_bytes(4, "little") for t, i in self.automaton.special.items()}

    def encode(self, text: str) -> bytes:
        word = self.words.__getitem__
        if self.cut is None or not any(t in text for t in self.special):
            return b"".join(map(word, self.find(text)))
        out = []
        for part in self.cut(text):
            out += [self.special[part]] if part in self.special else map(word, self.find(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after the other, as text."""
        tokens = np.frombuffer(ids, "<u4")
        if not len(tokens):
            return ""
        begin, length, letters = self.automaton.tape
        size = length[tokens]
        after = np.cumsum(size)
        return letters[np.arange(after[-1]) + np.repeat(begin[tokens] - after + size, size)].tobytes().decode("utf-8", "replace")


def _batches(batches: Iterable[pa.RecordBatch], make, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (key, value) through ``make``, in output batches of bounded size."""
    for batch in batches:
        keys, rows, size, begin = batch.column(0), [], 0, 0
        for i, value in enumerate(batch.column(1)):
            rows.append(make(value.as_py()))
            size += len(rows[-1][1] or "")
            if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(rows)), *(pa.array(x) for x in zip(*rows, strict=True))], names=names)
                rows, size, begin = [], 0, i + 1


def _shipped(docs: DataFrame, path: str):
    """The tokenizer file (a few MB whatever the input) for the executors, which need not have it."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, ids (packed little-endian uint32), decoded; one row per input row.

    Whole texts; a null text is empty, and an empty one has no tokens.  Repeated
    rows give repeated rows; other columns are ignored.  Tokenizer strings in a
    text (added tokens) are encoded as those tokens.
    """

    spec = _shipped(docs, path)

    def run(batches):
        codec = Codec(spec.value)

        def make(text):
            ids = codec.encode(text or "")
            return len(ids) // 4, ids, codec.decode(ids)

        yield from _batches(batches, make, ["doc_id", "n_tokens", "ids", "decoded"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, ids: as ``encode_decode`` without decoding."""

    spec = _shipped(docs, path)

    def run(batches):
        codec = Codec(spec.value)

        def make(text):
            ids = codec.encode(text or "")
            return len(ids) // 4, ids

        yield from _batches(batches, make, ["doc_id", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of ``encode_decode``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
