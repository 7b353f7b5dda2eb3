"""Language identification by error-correcting output codes.

Each language has a binary codeword; for each bit of the code a logistic
classifier on hashed byte n-grams predicts it.  Decoding weighs each bit's
logistic loss by how reliable its classifier is and chooses the codeword of
least loss; the text is flagged as ambiguous if the runner-up is nearly as near.

The model is fitted in numpy on a bounded sample of labelled rows, the same rows
at each run (least hashes), of every language that is there; what the driver gets of
a row are its histograms of n-grams, whatever the length of its text.  Prediction
reads whole texts in Arrow batches, with one histogram a document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm import shared

#: Hash buckets of two- and of three-byte grams.
BUCKETS = 1024
#: Labelled documents that the model is fitted on: FIT_DOCS of a language, or FIT_ROWS of all if that is less, but never under FIT_LEAST of a language.
FIT_DOCS, FIT_ROWS, FIT_LEAST = 250, 8000, 8
#: Lengths of the pieces of a text that the model is fitted on beside the whole.
PIECES = (40, 160)
#: Documents in a histogram block.
BLOCK = 256
#: A text is ambiguous if the runner-up's probability is above this share of the winner's.
AMBIGUOUS = 0.5
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")

# A-Z as a-z, other ASCII than letters as a blank.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else (b + 32 if 65 <= b <= 90 else 32) for b in range(256)], dtype=np.uint32)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Root relative frequencies of n-grams: documents x 2 * BUCKETS.

    Runs of blanks count as one; each document is read between two blanks.
    """
    n = len(offs) - 1
    out = np.zeros((n, 2 * BUCKETS), np.float32)
    folded = np.full(len(buf) + 2 * n, 32, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offs) + 2)
    place = np.arange(len(buf)) + 2 * np.repeat(np.arange(n), np.diff(offs)) + 1
    folded[place] = _FOLD[buf]
    blank = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
    folded, doc = folded[keep], doc[keep]
    if len(folded) < 3:
        return out
    pair = folded[:-1] << np.uint32(8) | folded[1:]
    triple = pair[:-1] << np.uint32(8) | folded[2:]
    for k, (grams, width) in enumerate(((pair, 1), (triple, 2))):
        own = doc[:-width] == doc[width:]
        code = (grams[own] * np.uint32(2654435761)) >> np.uint32(22)
        counts = np.bincount(doc[:-width][own] * BUCKETS + code, minlength=n * BUCKETS).reshape(n, BUCKETS)
        total = counts.sum(1, keepdims=True)
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = np.sqrt(counts / np.maximum(total, 1))
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: all splits of up to 6 languages, else a random code with well separated rows."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 6:
        bits = [[1 if j == 0 or (b >> (j - 1)) & 1 else -1 for j in range(n)] for b in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.float32).T
    best, gap = None, -1
    draw = np.random.default_rng(7)
    length = int(10 * np.ceil(np.log2(n)))
    for _ in range(max(1, 20_000 // (n * n))):
        code = draw.choice(np.array([-1, 1], np.float32), (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        alike = code @ code.T
        np.fill_diagonal(alike, -length)
        apart = (code.shape[1] - alike.max()) / 2
        if apart > gap:
            best, gap = code, apart
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, +-1
    weights: np.ndarray = field(default_factory=lambda: np.zeros((2 * BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # of each bit
    scale: float = 1.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row to each codeword."""
        margins = x @ self.weights + self.bias
        right, wrong = np.logaddexp(0, -margins) * self.trust, np.logaddexp(0, margins) * self.trust
        return right @ (self.code.T > 0).astype(np.float32) + wrong @ (self.code.T < 0).astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability, ambiguity."""
        if len(self.langs) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x)), np.zeros(len(x), bool)
        z = -self.scale * self.losses(x)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(x))
        first, second = p[rows, order[:, 0]], p[rows, order[:, 1]]
        return order[:, 0], first, second > AMBIGUOUS * first


def train(x: np.ndarray, y: np.ndarray, names: list[str], steps: int = 150) -> Model:
    """Fit on histograms and the indices of their languages in ``names``."""
    model = Model(names, codewords(len(names)))
    if len(names) < 2:
        return model
    target = model.code[y]
    balance = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y].astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        margin = target * (x @ w + b)
        pull = -target * balance / (1 + np.exp(np.clip(margin, -30, 30))) / len(y)
        mw = 0.9 * mw + x.T @ pull + 1e-6 * w
        mb = 0.9 * mb + pull.sum(0)
        w -= 20.0 * mw
        b -= 2.0 * mb
    model.weights, model.bias = w, b
    right = ((x @ w + b) * target > 0).mean(0)
    odds = np.log((right * len(y) + 1) / ((1 - right) * len(y) + 1))  # smoothed, as a boosted vote
    model.trust = (odds / odds.max()).astype(np.float32) if odds.max() > 0 else np.ones_like(odds, np.float32)
    return model


def sampled(rows: DataFrame, key: str, wanted: dict, name: str = "draw") -> DataFrame:
    """Of ``rows`` (key, draw: a 64-bit hash, ...) those of the least draws, ``wanted[value] = (limit, rows there are)`` of each value of ``key``.

    A first cut by a fixed share of the hash range leaves some three times the limit
    of each value, so no task ranks more than that, however many rows a value has.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(v, int(limit), min(1.0, (3 * limit + 100) / max(n, 1))) for v, (limit, n) in wanted.items()], T.StructType([T.StructField("of", rows.schema[key].dataType), T.StructField("most", T.LongType()), T.StructField("share", T.DoubleType())]))
    part = F.shiftrightunsigned(F.col(name), 11) / F.lit(float(1 << 53))
    near = rows.join(F.broadcast(table), rows[key] == F.col("of")).where(part < F.col("share"))
    others = [c for c in rows.columns if c not in (key, name)]
    near = near.distinct().withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy(F.shiftrightunsigned(F.col(name), 11), name, *others)))
    return near.where("place <= most").select(*rows.columns)


def _examples(column: pa.Array, draws: np.ndarray) -> list[bytes]:
    """Of each text the histograms (16-bit floats) of the whole and of a piece of each length, at a place that its draw tells."""
    out = []
    for text, draw in zip(column.to_pylist(), draws.view(np.uint64).tolist(), strict=True):
        pieces = [text]
        for k, length in enumerate(PIECES):
            at = (draw >> (24 * k)) % max(1, len(text) - length)
            pieces.append(text[at : at + length])
        x = np.concatenate([features(buf, offs) for _, buf, offs in shared.text_chunks(pa.array(pieces, pa.large_string()))])
        out.append(x.astype(np.float16).tobytes())
    return out


def fit(docs: DataFrame) -> Model:
    """Fit on ``docs`` (doc_id, text, lang): FIT_DOCS documents of each language (less with many languages), those of the least hash of doc_id and text.

    Every language takes part.  Rows whose lang or text is null or whose text is empty
    are not used; repeated rows count once.  Without labelled rows the model knows no
    language.  Texts stay in the cluster; the driver gets histograms.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], codewords(0))
    limit = max(FIT_LEAST, min(FIT_DOCS, FIT_ROWS // len(counts)))
    chosen = sampled(rows.select("lang", "draw"), "lang", {v: (limit, n) for v, n in counts.items()})
    # (lang, draw) names a text, repeats of it meet in the aggregate
    picked = rows.join(F.broadcast(chosen), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_examples(batch.column(2), batch.column(1).to_numpy(zero_copy_only=False)), pa.binary())], names=["lang", "draw", "x"])

    table = shared.map_arrow(picked.select("lang", "draw", "text"), run, "lang string, draw long, x binary").toArrow().sort_by([("lang", "ascending"), ("draw", "ascending")])
    names = sorted(counts)
    y = np.repeat(np.searchsorted(np.array(names, dtype=object), np.array(table["lang"].to_pylist(), dtype=object)), 1 + len(PIECES))
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(len(y), 2 * BUCKETS).astype(np.float32)
    del table
    model = train(x, y, names)
    del x
    shared.settle(docs.sparkSession)
    return model


def predictor(model: Model):
    """A function from an Arrow text column to (language or und, score, ambiguous) of each row."""

    def run(column: pa.Array):
        n = len(column)
        langs = np.full(n, UNDETERMINED, dtype=object)
        scores, ambiguous = np.zeros(n), np.ones(n, bool)
        for row, buf, offs in shared.text_chunks(column):
            for at in range(0, len(offs) - 1, BLOCK):
                part = offs[at : at + BLOCK + 1]
                own = buf[part[0] : part[-1]]
                m = len(part) - 1
                plain = np.concatenate([[0], np.cumsum((_FOLD[own] != 32) & (own < 128))])
                lettered = plain[part[1:] - part[0]] > plain[part[:-1] - part[0]]
                for i in np.flatnonzero(~lettered):  # without a-z: other letters?
                    lettered[i] = _LETTER.search(own[part[i] - part[0] : part[i + 1] - part[0]].tobytes().decode("utf-8", "replace")) is not None
                if not len(model.langs) or not lettered.any():
                    continue
                best, score, unsure = model.predict(features(own, part - part[0]))
                where = np.flatnonzero(lettered)
                to = row + at + where
                langs[to] = np.array(model.langs, dtype=object)[best[where]]
                scores[to], ambiguous[to] = score[where], unsure[where]
                assert m == len(lettered)
        return langs, scores, ambiguous

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score, ambiguous; one row per input row.

    lang_pred is a language of the model, or ``und`` (score 0, ambiguous) for a
    null text, one without any letter, or a model that knows no language.  score
    is the winner's probability.  Whole texts; only the text is read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        guess = predictor(shipped.value)
        for batch in batches:
            langs, scores, ambiguous = guess(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(ambiguous)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return shared.map_arrow(docs.select("doc_id", "text"), run, schema)


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language the model tells: not ``und``, and one language likelier than all others together.

    All columns are kept and nothing is shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        guess = predictor(shipped.value)
        for batch in batches:
            langs, scores, _ = guess(batch.column(at))
            yield batch.filter(pa.array((langs != UNDETERMINED) & (scores > 0.5)))

    return shared.map_arrow(docs, run, docs.schema)


def held_out(column: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its doc_id as text, modulo 5, is 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) -> doc_id, held_out, lang_pred, score, ambiguous, fitted on the rows not held out."""
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
