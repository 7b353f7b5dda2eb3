"""Toxicity by a convolutional text classifier.

Every word is hashed to a row of an embedding table.  Filters of several widths run
over the embeddings, each keeps its maximum over the whole text, and a logistic layer
reads the maxima.  All labelled rows take part: they are dealt into shards by a hash of
doc_id, each shard is trained on in a task (Adam in numpy, from common parameters), and
what the shards make of the parameters is averaged, a few times over.  One in CALIBRATE
rows of every shard is kept from training; all of these calibrate the threshold of each
language, so that score >= 0.5 is the decision; the language is that which ``langid``
reads from the text, never a column.

Rows of the table that fewer than LEAST_DOCS training documents read are zero, so
the model that ships is as large as their vocabulary.  At prediction a chunk of documents is
hashed, looked up, multiplied with all filters at once, added and reduced to maxima
by a few numpy calls.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm import langid, shared

#: Length of an embedding, filters of each width, rows of the table (2**ROW_BITS for words and one for padding).
DIM, FILTERS, WIDTHS, ROW_BITS = 8, 8, (1, 2, 3), 20
#: Labelled documents of a shard, and bytes of their texts, about.
SHARD_DOCS, SHARD_BYTES = 6000, 64 << 20
#: Bits of the table that tells which documents may have a label (of fixed size; a document it lets through in vain is dropped by the join).
SLOT_BITS = 25
#: Embeddings are trained for words that so many training documents hold; all others stay zero.
LEAST_DOCS = 2
#: Of a shard, one in so many calibrates.
CALIBRATE = 4
#: Readings of every training document, and rounds that many shards share them in.
EPOCHS, ROUNDS, BATCH, DECAY = 8, 4, 64, 1e-4
#: Steps of a score that the thresholds are told apart by, in one; scores beyond FARTHEST count as that.
CUTS, FARTHEST = 256, 64
#: Words that are scored at once.
STRETCH = 1 << 15

_TAPS = sum(WIDTHS)
# What is no letter parts words.
_PARTS = np.array([not (b >= 128 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])


def rows_of(hashes: np.ndarray) -> np.ndarray:
    """Embedding rows of word hashes; 0 is padding."""
    return (hashes >> np.uint64(64 - ROW_BITS)).astype(np.int32) + 1


def chunk_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's words and each document's first one."""
    starts, ends, first = shared.spans(buf, offs, _PARTS)
    return shared.word_hashes(buf, starts, ends), first


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with padding after each document, as far as filters reach, and where documents begin."""
    pad = max(WIDTHS) - 1
    n = len(first) - 1
    out = np.zeros(len(rows) + pad * n, np.int32)
    out[np.arange(len(rows)) + pad * np.repeat(np.arange(n), np.diff(first))] = rows
    return out, first + pad * np.arange(n + 1)


@dataclass
class Model:
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of the sample's words
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))  # their embeddings
    filters: np.ndarray = field(default_factory=lambda: np.zeros((DIM, _TAPS * FILTERS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    lang: langid.Model | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The embedding table: of each row its place among the embeddings, which begin with that of all zero rows."""
        place = np.zeros((1 << ROW_BITS) + 1, np.int32)
        place[self.rows] = np.arange(1, len(self.rows) + 1)
        return place, np.concatenate([np.zeros((1, DIM), np.float32), self.vectors])

    def logits(self, table: tuple[np.ndarray, np.ndarray], rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Raw score of each document of ``padded`` rows, some STRETCH words at a time (a longer document alone)."""
        out, at = np.zeros(len(first) - 1, np.float32), 0
        while at < len(out):
            end = max(at + 1, int(np.searchsorted(first, first[at] + STRETCH, "right")) - 1)
            out[at:end] = self._logits(table, rows[first[at] : first[end]], first[at : end + 1] - first[at])
            at = end
        return out

    def _logits(self, table: tuple[np.ndarray, np.ndarray], rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        place, vectors = table
        hidden = convolved(vectors[place[rows]] @ self.filters)
        hidden += self.bias
        hidden[rows == 0] = 0
        np.maximum(hidden, 0, out=hidden)
        # added up row by row: a product of matrices rounds by the number of documents beside one
        return (np.maximum.reduceat(hidden, first[:-1], axis=0).astype(np.float64) * self.out).sum(axis=1) + self.intercept


def convolved(taps: np.ndarray) -> np.ndarray:
    """Words x (taps * FILTERS) -> words x (widths * FILTERS): each filter's taps added along the text, from each word on."""
    m = len(taps)
    out = np.empty((m, len(WIDTHS) * FILTERS), np.float32)
    tap = 0
    for k, width in enumerate(WIDTHS):
        block = out[:, k * FILTERS : (k + 1) * FILTERS]
        block[:] = taps[:, tap * FILTERS : (tap + 1) * FILTERS]
        for j in range(1, width):
            block[: m - j] += taps[j:, (tap + j) * FILTERS : (tap + j + 1) * FILTERS]
        tap += width
    return out


def fresh(rows: np.ndarray, seed: int = 5) -> Model:
    """A model with small random parameters for these embedding rows."""
    draw = np.random.default_rng(seed)
    e = draw.normal(0, 0.02, (len(rows), DIM)).astype(np.float32)
    w = draw.normal(0, 0.3, (DIM, _TAPS * FILTERS)).astype(np.float32)
    pools = len(WIDTHS) * FILTERS
    return Model(rows, e, w, np.full(pools, 0.05, np.float32), np.full(pools, 0.2, np.float32), -1.0)


def train(model: Model, rows: np.ndarray, first: np.ndarray, toxic: np.ndarray, balance: tuple[float, float], epochs: int, seed: int) -> Model:
    """Embeddings, filters and the logistic layer, from those of ``model`` by Adam on shuffled batches of documents (rows of their words, and where each begins).

    ``balance`` weighs labels 0 and 1.  Of the embeddings a step changes those that a filter's maximum read.
    """
    draw = np.random.default_rng(seed)
    n, y = len(first) - 1, np.asarray(toxic, np.float32)
    rows, first = padded(rows, first)
    place = np.full((1 << ROW_BITS) + 1, len(model.rows) + 1, np.int32)  # the last row is that of words without an embedding of their own
    place[model.rows], place[0] = np.arange(1, len(model.rows) + 1), 0
    rows = place[rows]
    zero = np.zeros((1, DIM), np.float32)
    e = np.concatenate([zero, model.vectors, zero])
    w, b, v = model.filters.copy(), model.bias.copy(), model.out.copy()
    c = np.full(1, model.intercept, np.float32)
    params, rates = (e, w, b, v, c), (0.02, 0.005, 0.005, 0.01, 0.01)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(y > 0, balance[1], balance[0]).astype(np.float32)
    step = 0

    def change(k: int, at, grad: np.ndarray) -> None:
        mean, square = moments[k]
        mean[at] = 0.9 * mean[at] + 0.1 * grad
        square[at] = 0.99 * square[at] + 0.01 * grad * grad
        params[k][at] -= rates[k] * (mean[at] / (1 - 0.9**step)) / (np.sqrt(square[at] / (1 - 0.99**step)) + 1e-6)

    for _ in range(epochs):
        order = draw.permutation(n)
        for i in range(0, n, BATCH):
            batch = order[i : i + BATCH]
            lengths = first[batch + 1] - first[batch]
            begin = np.concatenate([[0], np.cumsum(lengths)])
            m = int(begin[-1])
            own = rows[np.repeat(first[batch] - begin[:-1], lengths) + np.arange(m)]
            x = e[own]
            hidden = convolved(x @ w)
            hidden[own == 0] = -np.inf  # a text without words has padding alone
            top = np.maximum.reduceat(hidden, begin[:-1], axis=0)
            doc = np.repeat(np.arange(len(batch)), lengths)
            at = np.minimum.reduceat(np.where(hidden == top[doc], np.arange(m)[:, None], m - 1), begin[:-1], axis=0)
            pools = np.maximum(top, -1e3) + b
            active = np.maximum(pools, 0)
            z = active @ v + c[0]
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            back = g[:, None] * v * (pools > 0)
            grad_w, read, pulls, tap = np.zeros_like(w), [], [], 0
            for k, width in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    place = np.minimum(at[:, k * FILTERS : (k + 1) * FILTERS] + j, m - 1)
                    taps = slice(tap * FILTERS, (tap + 1) * FILTERS)
                    grad_w[:, taps] = np.einsum("nfd,nf->df", x[place], part)
                    read.append(own[place].ravel())
                    pulls.append((part[:, :, None] * w[:, taps].T).reshape(-1, DIM))
                    tap += 1
            which, where = np.unique(np.concatenate(read), return_inverse=True)
            pulls = np.concatenate(pulls)
            grad_e = np.stack([np.bincount(where, pulls[:, d], len(which)) for d in range(DIM)], axis=1).astype(np.float32)
            step += 1
            change(0, which, grad_e + DECAY * e[which])
            e[[0, -1]] = 0
            for k, grad in enumerate((grad_w, back.sum(0), g @ active, g.sum(keepdims=True)), 1):
                change(k, slice(None), grad)
    return Model(model.rows, e[1:-1], w, b, v, float(c[0]))


def _best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold of least weighted error, midway between the scores beside it; ``n`` says how many rows a score and label stand for."""
    n = np.ones(len(z)) if n is None else n
    order = np.argsort(z, kind="stable")
    z, one, zero = z[order], (n * y)[order], (n * (1 - y))[order]
    last = np.flatnonzero(np.append(z[1:] != z[:-1], True)) if len(z) else np.zeros(0, int)  # equal scores lie on one side
    z = z[last]
    miss = np.concatenate([[0], np.cumsum(one)[last]]) / max(1, one.sum())  # positives below the cut
    false = (zero.sum() - np.concatenate([[0], np.cumsum(zero)[last]])) / max(1, zero.sum())
    best = np.flatnonzero((miss + false) == (miss + false).min())
    at = int(best[len(best) // 2])
    below = z[at - 1] if at else z[0] - 1
    above = z[at] if at < len(z) else z[-1] + 1
    return float((below + above) / 2)


def _marks(known: DataFrame) -> np.ndarray:
    """A bit for each slot that the hash of a labelled doc_id falls into."""
    slot = known.select(_slot().alias("s")).selectExpr("s div 64 AS at", "shiftleft(1L, cast(s % 64 AS int)) AS bit")
    found = slot.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _slot():
    return F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SLOT_BITS)


def _shards(docs: DataFrame, known: DataFrame, lang: langid.Model, shards: int) -> DataFrame:
    """toxic, lang, ends, rows: a row for each shard with the labels, languages and words (rows of the table) of its documents, in order of the draw."""
    spark = docs.sparkSession
    shipped, marks = spark.sparkContext.broadcast(lang), spark.sparkContext.broadcast(_marks(known))
    key = docs.schema["doc_id"].dataType

    def run(batches):
        guess = langid.predictor(shipped.value)
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((marks.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            own = []
            for _, buf, offs in shared.text_chunks(batch.column(3)):
                hashes, first = chunk_hashes(buf, offs)
                rows = rows_of(hashes)
                own += [rows[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array(guess(batch.column(3))[0], pa.string())], names=["doc_id", "digest", "rows", "lang"])

    def pack(batches):
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        for shard in np.unique(table["shard"].to_numpy()):
            own = table.filter(pa.array(table["shard"].to_numpy() == shard)).sort_by("draw")
            ends = np.cumsum([0] + [len(v) // 4 for chunk in own["rows"].chunks for v in (x.as_buffer() for x in chunk)])
            rows = b"".join(x.as_buffer() for chunk in own["rows"].chunks for x in chunk)
            yield pa.RecordBatch.from_arrays([pa.array([own["toxic"].to_pylist()], pa.list_(pa.int32())), pa.array([own["lang"].to_pylist()], pa.list_(pa.string())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([rows], pa.binary())], names=["toxic", "lang", "ends", "rows"])

    schema = T.StructType([T.StructField("doc_id", key), T.StructField("digest", T.LongType()), T.StructField("rows", T.BinaryType()), T.StructField("lang", T.StringType())])
    words = shared.map_arrow(docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("digest"), _slot().alias("slot"), "text"), run, schema)
    each = words.join(known, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("toxic", "draw", "rows", "lang"), "digest").alias("r"))
    dealt = each.select("r.*", F.pmod(F.hash("r.draw"), F.lit(shards)).alias("shard")).repartitionById(shards, F.col("shard"))
    return shared.cut(shared.map_arrow(dealt, pack, "toxic array<int>, lang array<string>, ends array<long>, rows binary"))


def _parts(batches, aside: bool | None):
    """Of each shard labels, languages, rows and first words of its documents: those that calibrate, those that do not, or (None) all."""
    for batch in batches:
        for toxic, langs, ends, rows in zip(*[batch.column(i) for i in range(4)], strict=True):
            y, ends = toxic.values.to_numpy(), ends.values.to_numpy()
            kept = np.ones(len(y), bool) if aside is None else (np.arange(len(y)) % CALIBRATE == CALIBRATE - 1) == aside
            lengths = np.diff(ends)
            own = np.frombuffer(rows.as_buffer(), np.int32)[np.repeat(kept, lengths)]
            yield y[kept], np.array(langs.as_py(), dtype=object)[kept], own, np.concatenate([[0], np.cumsum(lengths[kept])])


def _vocabulary(shards: DataFrame, aside: bool | None) -> np.ndarray:
    """Embedding rows that LEAST_DOCS training documents of all shards read."""

    def run(batches):
        for _, _, rows, first in _parts(batches, aside):
            own = np.unique(np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) << 32 | rows) & 0xFFFFFFFF
            which, n = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(n)], names=["row", "n"])

    held = shared.map_arrow(shards, run, "row int, n long").groupBy("row").agg(F.sum("n").alias("n"))
    return np.sort(held.where(F.col("n") >= LEAST_DOCS).select("row").toArrow()["row"].to_numpy())


def _averaged(shards: DataFrame, model: Model, aside: bool | None, balance: tuple[float, float], epochs: int, turn: int) -> Model:
    """Every shard trains on its documents from ``model``; an embedding is the mean of the shards that changed it, other parameters are that of all shards."""
    shipped = shards.sparkSession.sparkContext.broadcast(model)
    dense = lambda m: np.concatenate([m.filters.ravel(), m.bias, m.out, [m.intercept]])
    size = len(dense(model))
    columns = [f"d{i}" for i in range(DIM)]

    def run(batches):
        for y, _, rows, first in _parts(batches, aside):
            if not len(y):
                continue
            start = shipped.value
            own = train(start, rows, first, y, balance, epochs, turn + 1000 * len(y))
            moved = np.flatnonzero((own.vectors != start.vectors).any(1))
            others = np.zeros((-(-size // DIM), DIM))
            others.ravel()[:size] = dense(own)
            at = np.concatenate([moved, len(start.rows) + np.arange(len(others))]).astype(np.int32)
            value = np.concatenate([own.vectors[moved], others.astype(np.float32)])
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(value[:, i])) for i in range(DIM)]], names=["at", *columns])

    means = shared.map_arrow(shards, run, "at int, " + ", ".join(f"{c} float" for c in columns)).groupBy("at").agg(*[F.avg(c).alias(c) for c in columns]).toArrow()
    value = np.zeros((len(model.rows) + -(-size // DIM), DIM))
    value[: len(model.rows)] = model.vectors
    value[means["at"].to_numpy()] = np.stack([means[c].to_numpy() for c in columns], axis=1)
    shipped.destroy()
    flat, pools = value[len(model.rows) :].ravel()[:size].astype(np.float32), len(WIDTHS) * FILTERS
    w, b, v, c = np.split(flat, np.cumsum([DIM * _TAPS * FILTERS, pools, pools]))
    return Model(model.rows, value[: len(model.rows)].astype(np.float32), w.reshape(DIM, -1), b, v, float(c[0]))


def _measured(shards: DataFrame, model: Model, aside: bool | None) -> pa.Table:
    """lang, z, toxic, n: how many calibrating documents of each language and label have a score, in steps of 1 / CUTS."""
    shipped = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = shipped.value.table()
        for y, langs, rows, first in _parts(batches, aside):
            z = shipped.value.logits(table, *padded(rows, first)).astype(np.float64) if len(y) else np.zeros(0)
            step = np.floor(np.clip(z, -FARTHEST, FARTHEST) * CUTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(step), pa.array(y.astype(np.int32))], names=["lang", "z", "toxic"])

    found = shared.map_arrow(shards, run, "lang string, z int, toxic int").groupBy("lang", "z", "toxic").agg(F.count(F.lit(1)).alias("n")).toArrow()
    shipped.destroy()
    return found


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, toxic).

    All documents with a label take part, whole texts of any length, in training or in
    the thresholds.  A doc_id with several labels takes the greatest, one
    with several texts that of the least hash; null labels and null texts are not used.  With
    labels of one class or none the model scores every text alike (0.5 if it saw
    only label 1, else 0).  The driver gets parameters and counts of scores.
    """
    key = docs.schema["doc_id"].dataType
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast(key).alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("draw", F.xxhash64("doc_id"))
    texts, size = docs.where("text IS NOT NULL").agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = known.count()
    lang = langid.fit(docs)
    shards = max(1, -(-n // SHARD_DOCS), int(n * (size or 0) / max(1, texts) / SHARD_BYTES))
    table = _shards(docs, known, lang, shards)
    place = F.expr(f"transform(toxic, (y, i) -> struct(y AS toxic, i % {CALIBRATE} = {CALIBRATE - 1} AS aside))")
    counts = {(r["aside"], r["toxic"]): r["n"] for r in table.select(F.explode(place).alias("r")).groupBy("r.aside", "r.toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = {y for _, y in counts}
    if len(seen) < 2:
        return Model(intercept=0.0 if seen == {1} else -60.0)
    apart = len(counts) == 4  # both classes train, and both calibrate
    own = [sum(counts.get((a, y), 0) for a in ((False,) if apart else (False, True))) for y in (0, 1)]
    balance = (sum(own) / (2 * own[0]), sum(own) / (2 * own[1]))
    model = fresh(_vocabulary(table, False if apart else None))
    rounds = ROUNDS if shards > 1 else 1
    for turn in range(rounds):
        model = _averaged(table, model, False if apart else None, balance, EPOCHS // rounds, turn)
        shared.settle(docs.sparkSession)  # with the round's shuffle files
    model.lang = lang
    found = _measured(table, model, True if apart else None)
    names, z, y, many = np.array(found["lang"].to_pylist(), dtype=object), (found["z"].to_numpy() + 0.5) / CUTS, found["toxic"].to_numpy(), found["n"].to_numpy()
    model.threshold = _best_cut(z, y, many)
    for name in sorted(set(names)):
        at = names == name
        if min(many[at & (y == 1)].sum(), many[at & (y == 0)].sum()) >= 20:
            model.thresholds[name] = _best_cut(z[at], y[at], many[at])
    del table, found
    shared.settle(docs.sparkSession)
    return model


def _decider(model: Model):
    """A function from an Arrow text column to scores."""
    guess = langid.predictor(model.lang) if model.lang is not None and model.thresholds else None
    table = model.table()

    def run(column: pa.Array) -> np.ndarray:
        n = len(column)
        z = np.zeros(n)
        for row, buf, offs in shared.text_chunks(column):
            hashes, first = chunk_hashes(buf, offs)
            z[row : row + len(offs) - 1] = model.logits(table, *padded(rows_of(hashes), first))
        cut = np.full(n, model.threshold)
        if guess:
            langs, _, _ = guess(column)
            cut = np.array([model.thresholds.get(x, model.threshold) for x in langs])
        return 1 / (1 + np.exp(-np.clip(z - cut, -60, 60)))

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, score, predicted; one row per input row.

    score is a probability shifted so that the threshold of the text's language
    lies at 0.5; predicted is 1 from there.  A null, empty or wordless text is
    scored by the intercept alone.  Whole texts; only the text is read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        decide = _decider(shipped.value)
        for batch in batches:
            score = decide(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return shared.map_arrow(docs.select("doc_id", "text"), run, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept and nothing shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        decide = _decider(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(at)) < 0.5))

    return shared.map_arrow(docs, run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang), ``labels`` (doc_id, toxic) -> doc_id, held_out, score, predicted, fitted on rows not held out."""
    learn = ~F.coalesce(langid.held_out(), F.lit(False))
    model = fit(docs.where(learn), labels.where(learn))
    return predict(docs, model).select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
