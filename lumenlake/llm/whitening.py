"""Whitening of embeddings by a tall-skinny QR decomposition (TSQR).

Entries become whole numbers, so column sums are exact and rows are centred on the
exact mean.  Every partition folds its centred rows, a batch at a time, into one
triangular factor R of d x d; factors are merged ``FAN`` at a time in a tree, and the
last one's singular values and right vectors are those of the whole table: the
vectors are the principal components and the squares over n their variances.  No
covariance is formed, so small variances keep their digits.

What reaches the driver has d or d * d numbers whatever the number of rows; a task
holds one batch and one factor.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import shared

#: Factors that one task merges.
FAN = 16
#: Components that are returned.
COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + SHIFT; SCALE * c saturates at +-2**LIMIT_BITS.
SCALE, SHIFT, LIMIT_BITS = 1024, 100_000, 50
#: Longest vector that is taken: a factor has its square.
MOST_DIMENSIONS = 4096


@dataclass
class Whitening:
    """n vectors, exact sums of their whole-number entries, components (rows), their variances and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def scales(self) -> np.ndarray:
        """Deviation of each component; NaN where there is no variance to speak of."""
        floor = (max(len(self.sums), 1) * np.finfo(float).eps) ** 2 * self.trace
        return np.sqrt(np.where(self.variances > floor, self.variances, np.nan))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the vector of the rows without null or non-finite entries."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & finite).select("vec_id", F.col(column).alias("vector"))


def whole_numbers(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of int64; an entry that a shorter vector lacks counts as 0."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    c = np.zeros((len(lists), d))
    if (size == d).all():
        c[:] = flat[offsets[0] : offsets[-1]].reshape(len(lists), d)
    else:
        row = np.repeat(np.arange(len(lists)), size)
        c[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat[offsets[0] : offsets[-1]]
    most = float(1 << LIMIT_BITS)
    return np.clip(np.floor(SCALE * c), -most, most).astype(np.int64) + SHIFT


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: int64 where that holds it, else Python's integers."""
    top = max((abs(s) for s in sums), default=0)
    if n * int(np.abs(x).max(initial=0)) + top < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(v: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if v.dtype == object or np.abs(v).max(initial=0) >= 1 << 52 or v.shape[1] > 2048:
        return [sum(int(x) * int(x) for x in row) for row in v]
    v = np.abs(v)
    high, low = v >> 26, v & ((1 << 26) - 1)
    parts = [(high * high).sum(1), (high * low).sum(1), (low * low).sum(1)]
    return [(int(a) << 52) + (int(b) << 27) + int(c) for a, b, c in zip(*parts, strict=True)]


def _triangle(blocks: np.ndarray, d: int) -> np.ndarray:
    r = np.linalg.qr(blocks, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """Components of all usable vectors; None if there is none or they have no entries.  ValueError beyond MOST_DIMENSIONS."""
    rows = usable(vectors, column)
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n or not d:
        return None
    if d > MOST_DIMENSIONS:
        raise ValueError(f"a vector has {d} entries; at most {MOST_DIMENSIONS} are taken")

    def add(batches):
        total = np.zeros(d, object)
        for batch in batches:
            x = whole_numbers(batch.column(0), d)
            for at in range(0, len(x), 4096):  # 2**12 entries of 2**51 fit
                total = total + x[at : at + 4096].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(s) for s in total])], names=["i", "s"])

    only = rows.select("vector")
    added = shared.map_arrow(only, add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [0] * d
    for r in added.collect():
        sums[r["i"]] = int(r["s"])

    def factor(batches):
        r = np.zeros((0, d))
        for batch in batches:
            y = from_mean(whole_numbers(batch.column(0), d), n, sums).astype(np.float64) / n
            r = _triangle(np.vstack([r, y]), d)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], names=["place", "r"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.frombuffer(r).reshape(d, d) for r in group.sort_values("place")["r"]])
        return pd.DataFrame({"place": [int(group["place"].iloc[0]) // FAN], "r": [_triangle(stacked, d).tobytes()]})

    factors = shared.cut(shared.map_arrow(only, factor, "place long, r binary"))
    places = factors.agg(F.max("place")).first()[0] + 1
    while places > 1:
        factors = factors.groupBy(F.expr(f"place div {FAN}").alias("branch")).applyInPandas(merge, "place long, r binary")
        places = -(-places // FAN)
    last = np.frombuffer(factors.first()["r"]).reshape(d, d)
    _, s, turned = np.linalg.svd(last)
    k = min(components, d)
    sign = np.sign(turned[np.arange(d), np.abs(turned).argmax(1)])
    return Whitening(n, sums, (turned * sign[:, None])[:k], (s * s / n)[:k], float((s * s).sum() / n))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance; None without one."""
    d, k = len(model.sums), len(model.components)
    own = np.flatnonzero(np.isfinite(model.scales()))

    def moments(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            w = _whitened(whole_numbers(batch.column(0), d), model)[1]
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    got = np.zeros(k + k * k)
    for r in shared.map_arrow(usable(vectors, column).select("vector"), moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        got[r["i"]] = r["v"]
    mean = got[:k] / model.n  # nought but for rounding: rows are centred before they are multiplied
    off = np.abs(got[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(own, own)]
    return float(off.max()) if off.size else None


def _whitened(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    v = from_mean(x, model.n, model.sums)
    return v, (v.astype(np.float64) / model.n) @ (model.components / model.scales()[:, None]).T


def apply(vectors: DataFrame, model: Whitening, error: float | None, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    d, k = len(model.sums), len(model.components)
    share = model.variances / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches):
        for batch in batches:
            v, w = _whitened(whole_numbers(batch.column(1), d), model)
            m = len(v)
            exact = pa.array([decimal.Decimal(s) if s < 10**38 else None for s in square_sums(v)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), k))
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), exact.take(each), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(share, m)), pa.array([error] * (m * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = usable(vectors, column)
    kind = rows.schema["vec_id"].dataType.simpleString()
    return shared.map_arrow(rows, run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable row of ``vectors`` (vec_id, embedding), a row a component.

    Rows whose vector is null or holds null or non-finite entries are left out;
    repeated rows and null vec_ids count like any other.  Entries that shorter
    vectors lack count as 0; entries beyond 2**40 in size saturate.  A component
    without variance (copies of one vector, fewer vectors than entries) has a null
    ``whitened``, explains 0 and is left out of identity_error, which is null when no
    component has variance.  deviation is exact, null beyond 38 digits.  Equal
    variances leave the choice of components to rounding.  No usable row, or only
    empty vectors: an empty table.
    """
    model = fit(vectors, components, column)
    if model is None:
        return vectors.where(F.lit(False)).select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    return apply(vectors, model, identity_error(vectors, model, column), column)
