"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token of a text from the tokens on
both sides of it; the score of a document is the sum of these conditional log
probabilities (its pseudo-log-likelihood).  Tokens are runs of letters, runs of
digits and single symbols: all of a text but white space.

* Tokens are counted over all documents.  The counts grow with the corpus and stay a
  table of the cluster; the driver gets the words of LEAST occurrences or more, the
  most frequent TABLE at most.
* The most frequent of these (MOST at most) are outputs of the network.  All other
  words are predicted by frequency class (powers of two of their counts, and the
  class of words beyond the driver's table); a class's probability is parted among
  its words by their counts, with UNSEEN occurrences for words that the corpus does
  not have.  Counts beyond the driver's table are joined, never gathered.
* The network adds an embedding of each of the ``2 * REACH`` neighbours (a table for
  each place), applies a rectifier and predicts a *head* -- the most frequent words,
  the clusters of the others, the frequency classes -- and then the word in its
  cluster.  Weights of outputs are 2 ** x with a linear mantissa (one cast instead
  of an exponential) and normalised exactly.
* It is trained in numpy (Adagrad) on the windows of all positions of all documents,
  each in one of the rounds: each task trains on its documents from the common
  parameters, and the parameters are averaged, weighted by windows, in two grouped
  steps.  The driver gets one set of parameters a round.

A step takes a stretch of text and sorts its tokens once; outputs, clusters and
neighbours are then runs of rows, so no weights are gathered for a token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm import shared

#: Words that the driver and each task hold at most, with their counts.
TABLE = 1 << 20
#: Words of that table have so many occurrences.  Of the outputs the first SINGLES are in the head, the others in clusters of these sizes.
LEAST, SINGLES, CLUSTERS = 16, 48, (*[64] * 4, *[256] * 4, *[1024] * 4)
MOST = SINGLES + sum(CLUSTERS)
#: Frequency classes of the other words; the last one is that of words beyond the table.
RARE = 17
#: Occurrences kept for words that the corpus does not have.
UNSEEN = 0.5
#: Words on each side, hidden units.
REACH, HIDDEN = 2, 16
#: Rounds of training, which share the documents; positions of a step; its rate.
ROUNDS, STRETCH, RATE = 2, 16_384, 0.1
#: Pieces in which parameters are averaged, and partial averages of each.
PIECES, PARTIALS = 16, 32

_PLACES = [o for o in range(-REACH, REACH + 1) if o]
# Kinds of bytes: white space, letters, digits, symbols.
_KIND = np.array([0 if b in shared.SPACE_BYTES else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
# An output's weight is the float32 whose bits are the whole number x * _UNIT + _ZERO.
_UNIT, _ZERO = np.float32((1 << 23) / np.log(2)), np.float32(127 << 23)
_SLOT_BITS = 16


def everything(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens and each document's first one: runs of letters, runs of digits, single other ASCII characters."""
    if len(buf) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    kind = _KIND[buf]
    fresh = np.ones(len(buf) + 1, dtype=bool)
    fresh[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    fresh[offs] = True
    starts, ends = np.flatnonzero(fresh[:-1] & (kind > 0)), np.flatnonzero(fresh[1:] & (kind > 0)) + 1
    return shared.word_hashes(buf, starts, ends), np.searchsorted(starts, offs)


class Vocabulary:
    """Ids of token hashes: outputs by rank, then RARE frequency classes, then padding; shares of rare words in their class."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, beyond: int):
        """``words`` (hashes) with ``counts`` are the table, ``beyond`` the occurrences of all other words."""
        order = np.lexsort((words, -counts))
        words, counts = words[order], counts[order].astype(np.float64)
        self.outputs = min(MOST, len(words))
        self.pad = self.outputs + RARE
        kind = np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), RARE - 2)
        ids = np.where(np.arange(len(words)) < self.outputs, np.arange(len(words)), self.outputs + kind)
        #: Occurrences of each id's words; the last class keeps UNSEEN ones.
        self.mass = np.bincount(ids, counts, self.pad).astype(np.float64)
        self.mass[-1] += beyond + UNSEEN
        with np.errstate(divide="ignore"):
            share = np.log(counts / self.mass[ids])
        slot = (words[: self.outputs] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << _SLOT_BITS, self.outputs, np.int64)
        self.slots[slot[::-1]] = np.arange(self.outputs)[::-1]  # the more frequent of two words has the slot
        self.top = np.append(words[: self.outputs], np.uint64(0))
        by_hash = np.argsort(words)
        self.words, self.ids, self.shares = words[by_hash], ids[by_hash].astype(np.uint16), share[by_hash].astype(np.float32)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids; the places of words of the frequency classes, and their log shares (0 for those beyond the table)."""
        found = self.slots[(hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        ids = np.where(self.top[found] == hashes, found, self.pad - 1).astype(np.uint16)
        others = np.flatnonzero(ids == self.pad - 1)
        if not len(self.words):
            return ids, others, np.zeros(len(others), np.float32)
        own = hashes[others]
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        known = self.words[at] == own
        ids[others[known]] = self.ids[at[known]]
        rare = ids[others] >= self.outputs
        return ids, others[rare], np.where(known, self.shares[at], 0)[rare].astype(np.float32)


def line_of(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with REACH paddings before, between and after documents, and each token's place in that line."""
    n = len(first) - 1
    place = np.arange(len(ids)) + REACH * (np.repeat(np.arange(n), np.diff(first)) + 1)
    line = np.full(len(ids) + REACH * (n + 1), pad, np.uint16)
    line[place] = ids
    return line, place


class Network:
    """Embeddings for each place, hidden biases, head, clusters; the last row of an output layer are its biases."""

    def __init__(self, outputs: int):
        self.outputs, self.pad = outputs, outputs + RARE
        edges = np.minimum(np.cumsum([0, SINGLES, *CLUSTERS]), outputs)
        self.clusters = [(int(a), int(b)) for a, b in zip(edges[1:], edges[2:], strict=False) if b > a]
        self.singles = int(edges[1])
        sizes = [1] * self.singles + [b - a for a, b in self.clusters] + [1] * RARE
        #: Of each id, its output in the head.
        self.head = np.repeat(np.arange(len(sizes)), sizes)
        self.shapes = [(len(_PLACES), self.pad + 1, HIDDEN), (HIDDEN,), (HIDDEN + 1, len(sizes)), *[(HIDDEN + 1, b - a) for a, b in self.clusters]]
        self.squares: list[np.ndarray] = []
        self.room: dict[str, np.ndarray] = {}

    @classmethod
    def fresh(cls, mass: np.ndarray, seed: int = 3) -> Network:
        """Small random weights; output biases are the log frequencies of the outputs."""
        net = cls(len(mass) - RARE)
        draw = np.random.default_rng(seed)
        net.params = [draw.normal(0, 0.1, s).astype(np.float32) for s in net.shapes]
        net.params[0][:, net.pad] = 0
        net.params[1][:] = 0
        mass = mass + 0.5
        head = np.bincount(net.head, mass)
        net.params[2][-1] = np.log(head / head.sum())
        for w, (a, b) in zip(net.params[3:], net.clusters, strict=True):
            w[-1] = np.log(mass[a:b] / mass[a:b].sum())
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    @classmethod
    def unflat(cls, flat: np.ndarray, outputs: int) -> Network:
        net = cls(outputs)
        cuts = np.cumsum([int(np.prod(s)) for s in net.shapes])
        net.params = [p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, cuts[:-1]), net.shapes, strict=True)]
        return net

    def _room(self, name: str, rows: int, columns: int, kind=np.float32) -> np.ndarray:
        """A buffer that lives from step to step."""
        have = self.room.get(name)
        if have is None or have.size < rows * columns:
            have = self.room[name] = np.empty(rows * columns, kind)
        return have[: rows * columns].reshape(rows, columns)

    def _hidden(self, line: np.ndarray, a: int, e: int):
        """The tokens line[a:e] that are no padding, by id: their places from a, ids and hidden units (a column of ones last)."""
        order = np.argsort(line[a:e], kind="stable")
        ids = line[a:e].take(order)
        m = int(np.searchsorted(ids, self.pad))
        order, ids = order[:m], ids[:m].astype(np.int64)
        h = self._room("h", m, HIDDEN + 1)
        z, more = self._room("z", m, HIDDEN), self._room("more", m, HIDDEN)
        for p, o in enumerate(_PLACES):
            rows = line.take(order + (a + o))
            np.take(self.params[0][p], rows, axis=0, out=more if p else z, mode="clip")
            if p:
                z += more
        z += self.params[1]
        np.maximum(z, 0, out=h[:, :HIDDEN])
        h[:, HIDDEN] = 1
        return order, ids, h

    def _weights(self, h: np.ndarray, w: np.ndarray, own: np.ndarray):
        """Of each row of h: weights of the outputs, their sums, and the log probability of output ``own``."""
        w = w * _UNIT
        w[-1] += _ZERO
        x = self._room("x", len(h), w.shape[1])
        np.dot(h, w, out=x)
        np.clip(x, 1e8, 2e9, out=x)
        bits = self._room("bits", len(h), w.shape[1], np.int32)
        np.copyto(bits, x, casting="unsafe")
        weights = bits.view(np.float32)
        total = weights @ np.ones(w.shape[1], np.float32)
        return weights, total, np.log(weights[np.arange(len(h)), own] / total)

    def log_probabilities(self, line: np.ndarray) -> np.ndarray:
        """Of each token of a line (REACH paddings at either end) given its window; 0 at paddings."""
        out = np.zeros(len(line), np.float32)
        for a in range(REACH, len(line) - REACH, STRETCH):
            order, ids, h = self._hidden(line, a, min(a + STRETCH, len(line) - REACH))
            if not len(ids):
                continue
            logs = self._weights(h, self.params[2], self.head[ids])[2]
            for w, (low, high) in zip(self.params[3:], self.clusters, strict=True):
                i, j = np.searchsorted(ids, (low, high))
                if i < j:
                    logs[i:j] += self._weights(h[i:j], w, ids[i:j] - low)[2]
            out[a + order] = logs
        return out

    def _layer(self, k: int, h: np.ndarray, own: np.ndarray, sums: np.ndarray, met: np.ndarray, back: np.ndarray) -> float:
        """One step of an output layer on rows ``h`` with outputs ``own``; adds the gradient for h to ``back``, returns the loss.

        ``sums`` are the sums of h over the rows of each of the outputs ``met``.
        """
        w = self.params[k]
        weights, total, logs = self._weights(h, w, own)
        inverse = (1 / total)[:, None]
        grad = (h * inverse).T @ weights
        grad[:, met] -= sums.T
        pull = weights @ w[:HIDDEN].T
        pull *= inverse
        pull -= np.ascontiguousarray(w[:HIDDEN].T).take(own, axis=0)
        back += pull
        self._change(k, slice(None), grad)
        return -float(logs.sum())

    def _change(self, k: int, at, grad: np.ndarray) -> None:
        grad *= self.share
        square = self.squares[k][at] + grad * grad
        self.squares[k][at] = square
        np.sqrt(square, out=square)
        grad /= square
        grad *= RATE
        self.params[k][at] -= grad

    def step(self, line: np.ndarray, a: int, e: int) -> tuple[float, int]:
        """One step of Adagrad on the mean loss of the tokens line[a:e]; the loss and their number."""
        if not self.squares:
            self.squares = [np.full_like(p, 1e-6) for p in self.params]
        order, ids, h = self._hidden(line, a, e)
        m = len(ids)
        if not m:
            return 0.0, 0
        self.share = np.float32(1 / m)
        cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        which = ids[cut]
        sums = _group_sums(h, cut)
        heads = self.head[which]
        first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        back = self._room("back", m, HIDDEN)
        back[:] = 0
        loss = self._layer(2, h, self.head[ids], _group_sums(sums, first), heads[first], back)
        for k, (low, high) in enumerate(self.clusters):
            (i, j), (p, q) = np.searchsorted(ids, (low, high)), np.searchsorted(which, (low, high))
            if i < j:
                loss += self._layer(3 + k, h[i:j], ids[i:j] - low, sums[p:q], which[p:q] - low, back[i:j])
        back *= h[:, :HIDDEN] > 0
        self._change(1, slice(None), back.sum(0))
        spread = self._room("spread", e - a + 2 * REACH, HIDDEN)
        spread[:] = 0
        spread[order + REACH] = back
        for p, o in enumerate(_PLACES):
            # a token at place j is the neighbour o of the token at j - o
            rows = np.take(spread, order + (REACH - o), axis=0, out=self._room("more", m, HIDDEN), mode="clip")
            self._change(0, (p, which), _group_sums(rows, cut))
        return loss, m


def _group_sums(rows: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``cut``."""
    return np.add.reduceat(rows, cut, axis=0)


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text) -> (word: 64-bit hash, n) over all documents, added up in each task before the shuffle."""

    def each(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def total():
            words = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            unique, where = np.unique(words, return_inverse=True)
            return unique, np.bincount(where, counts).astype(np.int64)

        def out(words, counts):
            for i in range(0, len(words), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 200_000].view(np.int64)), pa.array(counts[i : i + 200_000])], names=["word", "n"])

        for batch in batches:
            for _, buf, offs in shared.text_chunks(batch.column(0)):
                words, counts = np.unique(everything(buf, offs)[0], return_counts=True)
                held.append((words, counts))
                size += len(words)
                if size >= 1 << 20:
                    words, counts = total()
                    held, size = [(words, counts)], len(words)
                    if size >= 1 << 19:
                        yield from out(words, counts)
                        held, size = [], 0
        if held:
            yield from out(*total())

    return shared.map_arrow(docs.select("text"), each, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _round(docs: DataFrame, outputs: int, vocabulary, flat, turn: int, rounds: int) -> tuple[np.ndarray | None, int]:
    """The weighted mean of what each task's documents of this round make of the common parameters, and the number of windows."""

    def local(batches):
        net = Network.unflat(flat.value, outputs)
        seen = chunk = 0
        for batch in batches:
            for _, buf, offs in shared.text_chunks(batch.column(0)):
                chunk += 1
                if (chunk - 1) % rounds != turn:  # another round's documents
                    continue
                hashes, first = everything(buf, offs)
                if len(hashes):
                    line, _ = line_of(vocabulary.value(hashes)[0], first, net.pad)
                    for a in range(REACH, len(line) - REACH, STRETCH):
                        seen += net.step(line, a, min(a + STRETCH, len(line) - REACH))[1]
        if seen:
            me = TaskContext.get().partitionId() % PARTIALS
            pieces = [p.tobytes() for p in np.array_split(net.flat(), PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([me] * PIECES, pa.int32()), pa.array([float(seen)] * PIECES), pa.array(pieces, pa.binary())], names=["piece", "part", "weight", "vals"])

    def mean(batches):
        total, weight = None, 0.0
        for batch in batches:
            for w, v in zip(batch.column("weight").to_pylist(), batch.column("vals").to_pylist(), strict=True):
                value = w * np.frombuffer(v, np.float32).astype(np.float64)
                total = value if total is None else total + value
                weight += w
            key = batch.select(["piece", "part"]).slice(0, 1)
        yield pa.RecordBatch.from_arrays([*key.columns, pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["piece", "part", "weight", "vals"])

    def merged(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(mean(rows.to_batches())))

    schema = "piece int, part int, weight double, vals binary"
    parts = shared.map_arrow(docs.select("text"), local, schema).groupBy("piece", "part").applyInArrow(merged, schema)
    rows = parts.groupBy("piece").applyInArrow(merged, schema).orderBy("piece").collect()
    return (np.concatenate([np.frombuffer(r["vals"], np.float32) for r in rows]), int(rows[0]["weight"])) if rows else (None, 0)


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    counts: DataFrame  # word, n: of the words beyond the vocabulary's table
    trained: int  # windows that the network was trained on


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Vocabulary and network of ``docs`` (text); without any word an untrained network."""
    context = docs.sparkSession.sparkContext
    counts = shared.cut(word_counts(docs))
    # how many words have how many occurrences: the least count, from LEAST on, that the driver's table takes
    steps = counts.groupBy(F.least("n", F.lit(TABLE)).alias("n")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("total")).orderBy(F.desc("n")).collect()
    floor, taken = LEAST, 0
    for r in steps:
        taken += r["words"]
        if taken > TABLE:
            floor = max(LEAST, r["n"] + 1)
            break
    beyond = sum(r["total"] for r in steps if r["n"] < floor)
    table = counts.where(F.col("n") >= floor).toArrow()
    vocabulary = Vocabulary(table["word"].to_numpy().view(np.uint64), table["n"].to_numpy(), beyond)
    del table
    shipped = context.broadcast(vocabulary)
    network = Network.fresh(vocabulary.mass)
    trained = 0
    for turn in range(rounds if steps else 0):
        flat, seen = _round(docs, vocabulary.outputs, shipped, context.broadcast(network.flat()), turn, rounds)
        trained += seen
        if flat is not None:
            network = Network.unflat(flat, vocabulary.outputs)
    return Model(vocabulary, network, counts.where(F.col("n") < floor), trained)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, log_prob, mean_log_prob, perplexity; one row per input row.

    log_prob is the sum over all tokens of the log probability given both sides; a
    null or empty text, or one without a token, has no tokens, log_prob 0, and null mean and
    perplexity.  Whole texts; other columns are ignored, repeated rows kept.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.network.flat()))

    def run(batches):
        vocabulary, flat = shipped.value
        network = Network.unflat(flat, vocabulary.outputs)
        last, unknown = vocabulary.pad - 1, np.log(vocabulary.mass[-1])
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            tokens, logs, others = np.zeros(n, np.int64), np.zeros(n), np.zeros(n + 1, np.int64)
            words = [np.zeros(0, np.uint64)]
            for row, buf, offs in shared.text_chunks(batch.column(1)):
                hashes, first = everything(buf, offs)
                counts = np.diff(first)
                tokens[row : row + len(counts)] = counts
                if len(hashes):
                    ids, rare, shares = vocabulary(hashes)
                    line, place = line_of(ids, first, vocabulary.pad)
                    each = network.log_probabilities(line)[place].astype(np.float64)
                    each[rare] += shares
                    at = np.flatnonzero(ids == last)
                    each[at] -= unknown
                    words.append(hashes[at])
                    others[row + 1 : row + 1 + len(counts)] = np.diff(np.searchsorted(at, first))
                    some = np.flatnonzero(counts)
                    logs[row + some] = np.add.reduceat(each, first[:-1][some])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(others).astype(np.int32)), pa.array(np.concatenate(words).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + n)), batch.column(0), pa.array(tokens), pa.array(logs), lists], names=["row", "doc_id", "n_tokens", "log_net", "words"])
            key += n

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_net", T.DoubleType()), T.StructField("words", T.ArrayType(T.LongType()))])
    scored = shared.map_arrow(docs.select("doc_id", "text"), run, schema)
    # rows without a word beyond the table take their number as key, so that they spread
    each = scored.select("row", "doc_id", "n_tokens", "log_net", F.explode_outer("words").alias("rare")).withColumn("word", F.coalesce("rare", "row"))
    share = F.when(F.col("rare").isNotNull(), F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))).otherwise(0.0)
    sums = each.join(model.counts, "word", "left").groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_tokens", "log_net")], F.sum(share).alias("log_words"))
    scored = sums.withColumn("log_prob", F.col("log_net") + F.col("log_words"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
