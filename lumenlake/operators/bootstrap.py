"""Thousands of cluster-bootstrap replicates as matrix products over blocks of rows.

A replicate draws as many units (patients) as there are, with replacement.  What a
metric needs of it is how often each unit was drawn, so all replicates are a matrix
of multiplicities, units by iterations -- which is never a table.  A task makes the
rows of the matrix that it needs from hashes, multiplies them with the weights of
its rows and hands on sums for each iteration; no row is joined with an iteration.

Exact draws from local hashes: a unit first gets a Poisson number with a mean a
little below 1, from a hash of (seed, iteration, number of the unit).  Sums of these
numbers over all units, one for each iteration, say how many draws are missing;
they are dealt uniformly, and only they are shuffled (a share of about 6 / sqrt(units)
of all draws).  Poisson numbers, given their sum, are a uniform deal of that many
draws, so the result is the multinomial deal of all of them.

Rank metrics work on stretches of the score.  Cut points come from a quantile sketch;
a score that many rows share is a stretch of its own and dealt over tasks by a hash
of the unit.  A stretch is read in order of the score with running sums for each
iteration, and what leaves it are three sums an iteration.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.operators.ordered import STRETCHES, cut_points, stretch_of
from lumenlake.operators.resample import numbered
from lumenlake.session import ship, spread

M32 = (1 << 32) - 1
#: Odd factors of iterations, units and draws (fixed values; the SQL of the queries has them too).
OF_ITERATION, OF_UNIT, OF_DRAW = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
#: Multiplicities that a task holds at once; they fit a core's cache.
BLOCK = 250_000
#: Thresholds that are compared with all hashes; the rest with those beyond them.
DENSE = 4
#: Iterations whose running sums one group of the last step holds.
ITERATIONS_AT_ONCE = 500


def finalise(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 32-bit numbers (the finaliser of a public-domain hash), on a fresh uint32 array."""
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def hashed(values: np.ndarray, factor: int, seed: int | np.ndarray) -> np.ndarray:
    """Hashes of whole numbers below 2**64 under a seed, or each under its own."""
    v = np.asarray(values, np.uint64)
    low, high = (v & np.uint64(M32)).astype(np.uint32), (v >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        return finalise(low * np.uint32(factor) + finalise(high + np.uint32(np.asarray(seed, np.int64) & M32)))


def closeness(units: int) -> int:
    """k, for a Poisson mean of 1 - 2**-k: the missing share is six deviations of the sum, or all draws of few units."""
    return max(0, math.floor(math.log2(max(math.sqrt(units) / 6, 1))))


def thresholds(units: int) -> list[int]:
    """Hashes from which a Poisson number is at least 1, 2, ..."""
    mean = 1 - 2.0 ** -closeness(units)
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while k < 20:
        total += term
        cut = math.floor(total * 2**32)
        if mean == 0 or cut > M32 or out and cut == out[-1]:
            break
        out.append(cut)
        k += 1
        term *= mean / k
    return out


@dataclass(frozen=True)
class Draws:
    """What a task needs to make multiplicities: iterations, seed, number of units."""

    iterations: int
    seed: int
    units: int

    def poisson(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers of units x iterations, uint8."""
        cuts = thresholds(self.units)
        if not cuts:
            return np.zeros((len(numbers), self.iterations), np.uint8)
        turn = hashed(np.arange(self.iterations), OF_ITERATION, self.seed)
        with np.errstate(over="ignore"):
            h = finalise(hashed(numbers, OF_UNIT, self.seed + 1)[:, None] + turn[None, :])
        out = (h >= np.uint32(cuts[0])).view(np.uint8)
        for cut in cuts[1:DENSE]:
            out += (h >= np.uint32(cut)).view(np.uint8)
        if len(cuts) > DENSE:  # few are drawn so often
            flat, at = out.reshape(-1), np.flatnonzero(h >= np.uint32(cuts[DENSE]))
            flat[at] = np.searchsorted(np.array(cuts, np.uint64), h.reshape(-1)[at].astype(np.uint64), "right")
        return out

    def topped(self, iteration: int, missing: int) -> np.ndarray:
        """Units of the missing draws of an iteration."""
        own = hashed(np.array([iteration]), OF_ITERATION, self.seed + 2)[0]
        first = hashed(np.arange(missing), OF_DRAW, int(own))
        with np.errstate(over="ignore"):
            second = finalise(first + np.uint32(OF_DRAW))
        u = (first.astype(np.uint64) << np.uint64(21)) + (second >> np.uint32(11)).astype(np.uint64)
        return np.floor(u.astype(np.float64) / 2.0**53 * self.units).astype(np.int64)

    def matrix(self, numbers: np.ndarray, extra: pa.ListArray) -> np.ndarray:
        """Multiplicities of rows of these units, rows x iterations, float64."""
        own, code = np.unique(numbers, return_inverse=True)
        first = np.unique(code, return_index=True)[1]
        m = self.poisson(own)
        if len(extra):
            lists = extra.take(pa.array(first))
            at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            np.add.at(m.reshape(-1), at * self.iterations + lists.flatten().to_numpy(zero_copy_only=False), 1)
        return m[code].astype(np.float64)


class Once:
    """The one replicate that has every row once."""

    iterations = 1

    def matrix(self, numbers: np.ndarray, extra: pa.ListArray) -> np.ndarray:
        return np.ones((len(numbers), 1))


def drawn(frame: DataFrame, unit: str, iterations: int, seed: int) -> tuple[DataFrame, Draws]:
    """``frame`` with _number (of the unit) and _extra (iterations of its dealt draws), and what makes multiplicities of them.

    Rows of a null unit are dropped.  One job numbers the units and adds up their
    Poisson numbers; the driver gets one sum for each iteration.
    """
    ship(frame.sparkSession)
    units = numbered(frame, unit).withColumnRenamed("n", "_number")
    units = spread(units.select(F.col(unit), "_number").checkpoint())  # each row costs a task a row of the matrix
    total = units.count()
    draws = Draws(iterations, seed, total)

    def sums(batches):
        out = np.zeros(iterations, np.int64)
        step = max(1, BLOCK // iterations)
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at in range(0, len(numbers), step):
                out += draws.poisson(numbers[at : at + step]).sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(iterations), pa.int32()), pa.array(out)], names=["iteration", "n"])

    have = np.zeros(iterations, np.int64)
    if closeness(total):
        for r in units.select("_number").mapInArrow(sums, "iteration int, n long").groupBy("iteration").agg(F.sum("n").alias("n")).collect():
            have[r["iteration"]] = r["n"]
    missing = np.maximum(total - have, 0)

    def deal(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                picked = draws.topped(i, int(missing[i]))
                yield pa.RecordBatch.from_arrays([pa.array(picked), pa.array(np.full(len(picked), i, np.int32))], names=["_number", "iteration"])

    turns = frame.sparkSession.range(iterations).repartition(max(1, min(iterations, frame.sparkSession.sparkContext.defaultParallelism * 4)))
    extra = turns.mapInArrow(deal, "_number long, iteration int").groupBy("_number").agg(F.collect_list("iteration").alias("_extra"))
    both = units.join(extra, "_number", "left").withColumn("_extra", F.coalesce("_extra", F.array().cast("array<int>")))
    return frame.join(both, unit), draws


# ------------------------------------------------------------------ sums for each iteration


def summed(frame: DataFrame, draws: Draws, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, iteration, <value>...: the sum of each value times the multiplicity of the row's unit, over ``drawn`` rows.

    Rows are added up in each task; what moves has a row for each task, key and iteration.
    """
    n, k = len(keys), len(values)
    kinds = [frame.schema[c] for c in keys]
    schema = T.StructType([*kinds, T.StructField("iteration", T.IntegerType()), *[T.StructField(v, T.DoubleType()) for v in values]])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(n)]
            names = list(zip(*columns, strict=True)) if n else [()] * batch.num_rows
            value = np.column_stack([batch.column(n + j).to_numpy(zero_copy_only=False) for j in range(k)])
            order: dict[tuple, int] = {}
            code = np.array([order.setdefault(x, len(order)) for x in names], np.int64)
            step = max(1, BLOCK // draws.iterations)
            for at in range(0, batch.num_rows, step):
                part = slice(at, at + step)
                m = draws.matrix(batch.column(n + k).to_numpy()[part], batch.column(n + k + 1).slice(at, step))
                for key, c in order.items():
                    own = code[part] == c
                    if own.any():
                        add = value[part][own].T @ m[own]
                        held[key] = held[key] + add if key in held else add
        for key, total in held.items():
            fixed = [pa.array([x] * draws.iterations, f) for x, f in zip(key, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(draws.iterations), pa.int32()), *[pa.array(total[j]) for j in range(k)]], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in kinds]
    rows = frame.select(*keys, *[F.col(v).cast("double").alias(v) for v in values], "_number", "_extra")
    return rows.mapInArrow(run, schema).groupBy(*keys, "iteration").agg(*[F.sum(v).alias(v) for v in values])


# ------------------------------------------------------------------ rank metrics


def _vector(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def _stretches(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: str, stretches: int = STRETCHES) -> DataFrame:
    """Rows that take part, with _s (score), _stretch (a number that rises with the score), and _salt: the rows of a score of its own are dealt into as many parts as it has shares."""
    rows = frame.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    rows = rows.select(*keys, F.col(score).cast("double").alias("_s"), (F.col(target) == 1).alias("_y"), F.col(weight).cast("double").alias("_w"), "_number", "_extra")
    cuts = cut_points(rows, "_s", stretches)
    at, single = stretch_of(F.col("_s"), cuts)
    shares = {c: n for c, n in Counter(cuts).items() if n > 1}
    salts = F.element_at(F.array(*map(F.lit, shares.values())), F.array_position(F.array(*map(F.lit, shares)), F.col("_s")).cast("int")) if shares else F.lit(1)
    salt = F.when(single, F.pmod(F.xxhash64("_number"), salts)).otherwise(F.lit(0))
    return rows.withColumns({"_stretch": at, "_single": single, "_salt": salt.cast("int")})


def _blocks(batches, n_keys: int, draws: Draws):
    """Sorted rows as (key with stretch and salt, single, scores, weights of positives and negatives by distinct score and iteration)."""
    step = max(1, BLOCK // draws.iterations)
    for batch in batches:
        size = batch.num_rows
        names = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)], strict=True))
        edges = [i for i in range(size) if i == 0 or names[i] != names[i - 1]] + [size]
        s = batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
        y = batch.column(n_keys + 2).to_numpy(zero_copy_only=False)
        w = batch.column(n_keys + 3).to_numpy(zero_copy_only=False)
        number, extra = batch.column(n_keys + 4).to_numpy(), batch.column(n_keys + 5)
        single = batch.column(n_keys).to_pylist()
        for a, b in zip(edges, edges[1:], strict=False):
            for low in range(a, b, step):
                high = min(b, low + step)
                m = draws.matrix(number[low:high], extra.slice(low, high - low))
                part = s[low:high]
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                wp, wn = (_by_score(m, w[low:high] * of, starts) for of in (y[low:high], ~y[low:high]))
                yield names[a], single[a], part[starts], wp, wn


def _by_score(m: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weighted sums of the rows of each score, scores by iterations."""
    if len(starts) <= 8:
        one = np.zeros((len(starts), len(w)))
        one[np.searchsorted(starts, np.arange(len(w)), "right") - 1, np.arange(len(w))] = w
        return one @ m
    if len(starts) == len(w):
        return m * w[:, None]
    return np.add.reduceat(m * w[:, None], starts, axis=0)


def replicate_auc(frame: DataFrame, draws: Draws, unit: str, target: str, scores: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys, iteration, <score>...: the AUC of each score in each replicate that has both classes, over ``drawn`` rows.

    Weights are 1 / rows of the unit (of the key), or the column ``weight``.
    """
    out = None
    rows = frame
    if weight is None:
        sizes = frame.groupBy(*keys, unit).agg((F.lit(1.0) / F.count(F.lit(1))).alias("_share"))
        rows, weight = frame.join(sizes, [*keys, unit]), "_share"
    for score in scores:
        one = _auc(rows, draws, keys, target, score, weight).withColumnRenamed("auc", score)
        out = one if out is None else out.join(one, [*keys, "iteration"])
    return out


def plain_auc(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: str, stretches: int) -> DataFrame:
    """keys, auc, as ``metrics.auc`` but for cohorts of one class: one shuffle of the rows, for many keys of many distinct scores.

    A key is cut into ``stretches``; one that fits a task needs no more than one.
    """
    rows = frame.withColumns({"_number": F.lit(0).cast("long"), "_extra": F.array().cast("array<int>")})
    return _auc(rows, Once(), keys, target, score, weight, stretches).drop("iteration")


def _sorted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = [*keys, "_stretch", "_salt"]
    spark = rows.sparkSession  # rows are few and heavy, so adaptive execution would put them together
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *by).sortWithinPartitions(*by, "_s").select(*by, "_single", "_s", "_y", "_w", "_number", "_extra")


def _auc(frame: DataFrame, draws: Draws | Once, keys: Sequence[str], target: str, score: str, weight: str, stretches: int = STRETCHES) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    rows = _stretches(frame, keys, target, score, weight, stretches)
    kinds = [rows.schema[c] for c in keys]
    arrow = [to_arrow_type(f.dataType) for f in kinds]
    n = len(keys) + 2
    parts = T.StructType([*kinds, T.StructField("_stretch", T.IntegerType()), T.StructField("_single", T.BooleanType()), T.StructField("_part", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("wp", "wn", "won")]])
    width = min(ITERATIONS_AT_ONCE, draws.iterations)
    kinds_out = [*arrow, pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        now = None  # key, single, positives, negatives, won, last score with its weights (a score may go on in the next batch)

        closed: list[tuple] = []

        def close(pending):
            key, single, tp, tn, won, _, lp, ln = pending
            won = won + lp * (tn + ln / 2)
            for p, at in enumerate(range(0, draws.iterations, width)):
                closed.append((*key[:-1], single, p, *[x[at : at + width].tobytes() for x in (tp + lp, tn + ln, won)]))
            if len(closed) * width > BLOCK:
                yield packed()

        def packed():
            columns = list(zip(*closed, strict=True))
            closed.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_out, strict=True)], names=parts.names)

        for key, single, s, wp, wn in _blocks(batches, n, draws):
            if now is None or now[0] != key:
                if now is not None:
                    yield from close(now)
                zero = np.zeros(draws.iterations)
                now = (key, single, zero, zero, zero, None, zero, zero)
            _, _, tp, tn, won, last, lp, ln = now
            if last == s[0]:
                wp[0] += lp
                wn[0] += ln
            else:
                won, tp, tn = won + lp * (tn + ln / 2), tp + lp, tn + ln
            if len(s) > 1:
                before = tn + np.cumsum(wn[:-1], axis=0) - wn[:-1]
                won = won + (wp[:-1] * (before + wn[:-1] / 2)).sum(0)
                tp, tn = tp + wp[:-1].sum(0), tn + wn[:-1].sum(0)
            now = (key, single, tp, tn, won, s[-1], wp[-1], wn[-1])
        if now is not None:
            yield from close(now)
        if closed:
            yield packed()

    schema = T.StructType([*kinds, T.StructField("iteration", T.IntegerType()), T.StructField("auc", T.DoubleType())])

    def merge(table: pa.Table) -> pa.Table:
        """Parts of one key and one range of iterations: at most a few hundred stretches and salts."""
        table = table.combine_chunks()
        at = np.array(table.column("_stretch").to_pylist())
        single = np.array(table.column("_single").to_pylist())
        vectors = [np.array([np.frombuffer(v) for v in table.column(c).to_pylist()]) for c in ("wp", "wn", "won")]
        own, code = np.unique(at, return_inverse=True)
        wp, wn, won = (np.zeros((len(own), vectors[0].shape[1])) for _ in range(3))
        for x, v in zip((wp, wn, won), vectors, strict=True):
            np.add.at(x, code, v)
        alone = np.zeros(len(own), bool)
        alone[code[single]] = True
        won = np.where(alone[:, None], wp * wn / 2, won)  # salts of one score tie with each other
        before = np.cumsum(wn, axis=0) - wn
        pairs = wp.sum(0) * wn.sum(0)
        value = (won + wp * before).sum(0) / np.where(pairs > 0, pairs, 1)
        keep = np.flatnonzero(pairs > 0)
        first = table.column("_part")[0].as_py() * width
        fixed = [pa.array([table.column(c)[0].as_py()] * len(keep), t) for c, t in zip(keys, arrow, strict=True)]
        return pa.Table.from_arrays([*fixed, pa.array((keep + first).astype(np.int32)), pa.array(value[keep])], names=schema.names)

    return _sorted(rows, keys).mapInArrow(run, parts).groupBy(*keys, "_part").applyInArrow(merge, schema)


def replicate_average_precision(frame: DataFrame, draws: Draws, target: str, score: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, iteration, average_precision in each replicate with a positive, over ``drawn`` rows.

    Two reads: sums of the stretches first; then each stretch, from the highest
    score down, with the sums above it as its first row.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = _stretches(frame, keys, target, score, weight)
    rows = rows.withColumns({"_s": -F.col("_s"), "_stretch": -F.col("_stretch"), "_salt": F.lit(0)})
    kinds = [rows.schema[c] for c in keys]
    arrow = [to_arrow_type(f.dataType) for f in kinds]
    n = len(keys) + 2
    dealt = _sorted(rows, keys)
    sums = T.StructType([*kinds, T.StructField("_stretch", T.IntegerType()), T.StructField("wp", T.BinaryType()), T.StructField("wn", T.BinaryType())])

    def add(batches):
        held: dict[tuple, list] = {}
        for key, _, _, wp, wn in _blocks(batches, n, draws):
            at = held.setdefault(key, [0.0, 0.0])
            at[0], at[1] = at[0] + wp.sum(0), at[1] + wn.sum(0)
        for key, (wp, wn) in held.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(key[:-2], arrow, strict=True)], pa.array([key[-2]], pa.int32()), _vector(wp), _vector(wn)], names=sums.names)

    def ahead(table: pa.Table) -> pa.Table:
        """Sums above each stretch of one key (some hundred)."""
        table = table.combine_chunks()
        order = np.argsort(table.column("_stretch").to_numpy())
        table = table.take(pa.array(order))
        out = []
        for c in ("wp", "wn"):
            v = np.array([np.frombuffer(x) for x in table.column(c).to_pylist()])
            out.append(pa.array([x.tobytes() for x in np.cumsum(v, axis=0) - v], pa.binary()))
        return pa.Table.from_arrays([*[table.column(c) for c in [*keys, "_stretch"]], *out], names=sums.names)

    above = dealt.mapInArrow(add, sums).groupBy(*keys).applyInArrow(ahead, sums)
    heads = above.select(*keys, "_stretch", F.lit(0).alias("_salt"), F.lit(False).alias("_single"), F.lit(float("-inf")).alias("_s"), F.lit(False).alias("_y"), F.lit(0.0).alias("_w"), F.lit(0).cast("long").alias("_number"), F.array().cast("array<int>").alias("_extra"), "wp", "wn")
    body = rows.select(*keys, "_stretch", "_salt", "_single", "_s", "_y", "_w", "_number", "_extra", F.lit(None).cast("binary").alias("wp"), F.lit(None).cast("binary").alias("wn"))
    by = [*keys, "_stretch", "_salt"]
    stream = body.unionByName(heads).repartition(*by).sortWithinPartitions(*by, "_s", F.col("wp").isNull())
    schema = T.StructType([*kinds, T.StructField("iteration", T.IntegerType()), T.StructField("gained", T.DoubleType()), T.StructField("positives", T.DoubleType())])

    def run(batches):
        tp = tn = None
        held: dict[tuple, list] = {}
        last, lp, ln = None, 0.0, 0.0

        def settle(key):
            nonlocal tp, tn, last, lp, ln
            if last is not None:
                tp, tn = tp + lp, tn + ln
                taken = tp + tn
                at = held.setdefault(key, [0.0, 0.0])
                at[0] = at[0] + lp * tp / np.where(taken > 0, taken, 1)
                at[1] = at[1] + lp
            last = None

        now = None
        for batch in batches:
            marks = batch.column(n + 6)
            heads_at = np.flatnonzero(~np.asarray(marks.is_null()))
            edges = sorted({0, batch.num_rows, *heads_at.tolist(), *(heads_at + 1).tolist()})
            for a, b in zip(edges, edges[1:], strict=False):
                piece = batch.slice(a, b - a)
                if piece.column(n + 6)[0].as_py() is not None:
                    if now is not None:
                        settle(now)
                    tp, tn = (np.frombuffer(piece.column(n + 6 + i)[0].as_py()).copy() for i in (0, 1))
                    now = tuple(piece.column(i)[0].as_py() for i in range(len(keys)))
                    continue
                for _, _, s, wp, wn in _blocks([piece], n, draws):
                    for i in range(len(s)):
                        if last is not None and s[i] == last:
                            lp, ln = lp + wp[i], ln + wn[i]
                        else:
                            settle(now)
                            last, lp, ln = s[i], wp[i], wn[i]
        if now is not None:
            settle(now)
        for key, (gained, positives) in held.items():
            fixed = [pa.array([x] * draws.iterations, t) for x, t in zip(key, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(draws.iterations), pa.int32()), pa.array(gained), pa.array(positives)], names=schema.names)

    got = stream.mapInArrow(run, schema).groupBy(*keys, "iteration").agg(F.sum("gained").alias("g"), F.sum("positives").alias("p"))
    return got.where("p > 0").select(*keys, "iteration", (F.col("g") / F.col("p")).alias("average_precision"))


def factorial_deltas(replicates: DataFrame, full: str, ablated: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Of ``replicate_auc`` with the full model and ablated ones: keys, model, interval of full - ablated; and the audit of valid replicates.

    The audit has keys, model, replicates, failed -- whose failed rows have no valid replicate.
    """
    from lumenlake.operators.resample import interval

    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("model"), (F.col(full) - F.col(a)).alias("delta")) for a in ablated]))
    long = replicates.select(*keys, pairs.alias("p")).select(*keys, "p.model", "p.delta")
    table = interval(long, [*keys, "model"], "delta")
    every = reduce(DataFrame.unionByName, [replicates.sparkSession.createDataFrame([(a,)], "model string") for a in ablated])
    if keys:
        every = replicates.select(*keys).distinct().crossJoin(F.broadcast(every))
    counts = long.groupBy(*keys, "model").agg(F.count("delta").alias("replicates"))
    audit = every.join(counts, [*keys, "model"], "left").withColumn("replicates", F.coalesce("replicates", F.lit(0))).withColumn("failed", F.col("replicates") == 0)
    return table, audit
