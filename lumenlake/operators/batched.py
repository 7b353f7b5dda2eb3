"""Many ridge logistic fits at once, by Newton steps that share their scans.

A study fits thousands of models on parts of one table: repeats, held folds, values
of C, subsets of columns, bootstrap draws.  Here a *part* is a weighting of the rows
(1 in a training part and 0 outside it, or the multiplicities of a replicate), and a
*fit* names a part, a C and columns.  One scan adds up loss, gradient and curvature of
all fits in every task, as matrix products over a block of rows; the driver takes one
Newton step for each fit and the next scan evaluates them.  No part is ever copied,
gathered or shuffled, so a fit takes any number of rows, and some ten scans serve all.

Scaling and weights are those of the part: a first scan adds up its moments and the
weight of each stratum in it, so nothing outside a training part enters its fit.
What a task hands on has the size of the fits' parameters and is added up in a tree.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.models import sigmoid
from lumenlake.operators.bootstrap import Draws
from lumenlake.operators.learn import scaling
from lumenlake.session import arrow_rows, shared_dir, ship

#: Strata of a study at most (their weights are parameters of every fit).
MOST_STRATA = 10_000
#: Numbers of the largest temporary of a task, and bytes of sums that the driver takes without a tree.
BLOCK, DIRECT_BYTES = 1_000_000, 32 << 20
#: Numbers of a temporary of a scan.
IN_CACHE = 40_000
#: Scores that a task keeps before it passes them on, rows of a stretch of scores, and quantiles of a task that cut stretches.
KEPT, ROWS_IN_STRETCH, QUANTILES = 2_000_000, 1_000_000, 64
#: Sums that one task of the tree adds up, and rows of an Arrow batch of a scan.
FAN, ROWS_IN_BATCH = 16, 10_000
#: The last is the width of the smoothed corner of the hinge loss.  Curvature is first taken over a wider one -- the first, or the next ones for starts near the minimum -- which shrinks by a factor each step.
SMOOTH, NARROWED = (1.0, 0.1, 0.03, 0.01), 0.8
#: Shares of a machine's step that are tried together.
LENGTHS = (1.6, 1.25, 1.0, 0.8, 0.6, 0.45, 0.33, 0.25, 0.18, 0.12, 0.08, 0.05, 0.03, 0.015, 0.005, 1e-3, 1e-4)
#: Rows, about, on which the start of a large table's machines is worked out; each further start has ten times as many.
START_ROWS = 100_000


@dataclass(frozen=True)
class Held:
    """The rows whose number in ``slot`` is one of ``values``."""

    slot: int
    values: tuple[int, ...]


@dataclass(frozen=True)
class Replicate:
    """All rows, as often as a bootstrap iteration drew their unit."""

    iteration: int


@dataclass(frozen=True)
class Fit:
    """A model: part (position in the study's parts), C, columns (positions), and columns that enter as ``k`` whitened components."""

    part: int
    c: float
    columns: tuple[int, ...]
    embedded: tuple[int, ...] = ()
    k: int = 0
    #: logistic, or hinge: the hinge loss with a quadratic corner, of the last width of SMOOTH
    loss: str = "logistic"


@dataclass
class Study:
    """Rows ready for scans: keys, target, _x (columns, scaled over all rows), _y, _w (weight within the stratum), _stratum, _slots, _number, _extra."""

    rows: DataFrame
    keys: list[str]
    columns: list[str]
    target: str
    strata: int
    parts: list = field(default_factory=list)
    draws: Draws | None = None
    #: mean and deviation of all rows that _x was scaled by
    scale: dict = field(default_factory=dict)
    #: tasks of a scan, once it is known
    places: int = 0


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder."""
    path = f"{shared_dir(rows.sparkSession)}/study-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def prepare(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, slots: Column | None = None, strata: Sequence[str] | None = None, group: str | None = None, draws: Draws | None = None, share: Sequence[str] = ()) -> Study:
    """A study of the rows that have a target (0 or 1) and finite columns; worked out and written once to the shared folder, dealt over all cores, and scanned from there.

    ``slots`` is an array of whole numbers above -2, the assignments that ``Held``
    asks for.  Strata weigh alike in every part, by default the two classes; with
    ``group``, groups weigh alike within a stratum.  ``draws`` (of ``bootstrap.drawn``)
    allows ``Replicate`` parts.  ``share`` names columns of a group by whose size rows
    get a key ``share``, one part in its number of rows.
    """
    spark = frame.sparkSession
    ship(spark)
    strata = list(strata or [target])
    finite = F.col(target).isin(0, 1)
    for c in columns:
        x = F.col(c).cast("double")
        finite &= x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = list(dict.fromkeys([*keys, target, *columns, *strata, *([group] if group else []), *share, *(["_number", "_extra"] if draws else [])]))
    given = frame.where(finite).select(*kept, (slots if slots is not None else F.array().cast("array<int>")).cast("array<int>").alias("_slots"))
    rows = written(given.repartition(4 * spark.sparkContext.defaultParallelism))
    found = rows.select(*strata).distinct().limit(MOST_STRATA + 1).collect()
    if len(found) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    name = lambda values: "\x1f".join("\x00" if v is None else str(v) for v in values)
    order = sorted(name(r) for r in found)
    code = F.array_position(F.array(*map(F.lit, order)), F.concat_ws("\x1f", *[F.coalesce(F.col(s).cast("string"), F.lit("\x00")) for s in strata])) - 1 if order else F.lit(0)
    base = F.lit(1.0)
    if group is not None:
        sizes = rows.groupBy(*strata, group).agg((F.lit(1.0) / F.count(F.lit(1))).alias("_w"))
        rows, base = rows.join(sizes, [*strata, group]), F.col("_w")
    if share:
        each = rows.groupBy(*share).agg((F.lit(1.0) / F.count(F.lit(1))).alias("share"))
        rows, keys = rows.join(each, list(share)), [*keys, "share"]
    scale = scaling(rows, columns)
    ready = rows.select(
        *keys,
        F.col(target).cast("int").alias(target),
        F.array(*[(F.col(c).cast("double") - m) / s for c, (m, s) in scale.items()]).alias("_x"),
        F.col(target).cast("double").alias("_y"),
        base.alias("_w"),
        code.cast("int").alias("_stratum"),
        "_slots",
        *(["_number", "_extra"] if draws else []),
    )
    if group is not None or share:  # a join is made once, not in every scan
        ready = written(ready.repartition(4 * spark.sparkContext.defaultParallelism))
    return Study(ready, list(keys), list(columns), target, max(len(order), 1), draws=draws, scale=scale)


class _Rows:
    """A block of rows as matrices."""

    def __init__(self, batch: pa.RecordBatch, d: int, parts: list, draws: Draws | None):
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        m = batch.num_rows
        self.x = np.column_stack([col["_x"].flatten().to_numpy(zero_copy_only=False).reshape(m, d), np.ones(m)])
        self.y, self.w = col["_y"].to_numpy(), col["_w"].to_numpy()
        self.stratum = col["_stratum"].to_numpy()
        slots = col["_slots"].flatten().to_numpy(zero_copy_only=False)
        self.slots = slots.reshape(m, -1) if len(slots) else np.zeros((m, 0), np.int32)
        drawn = [p.iteration for p in parts if isinstance(p, Replicate)]
        times = draws.matrix(col["_number"].to_numpy(), col["_extra"]) if drawn else None
        #: rows x parts: how often a row takes part
        if drawn and len(drawn) == len(parts):
            self.members = times if drawn == list(range(times.shape[1])) else times[:, drawn]
            return
        self.members = np.column_stack([times[:, p.iteration] if isinstance(p, Replicate) else self.among(p) for p in parts]) if parts else np.zeros((m, 0))

    def among(self, held: Held) -> np.ndarray:
        return np.isin(self.slots[:, held.slot], held.values).astype(np.float64)


def _pieces(batches, rows_at_once: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows_at_once):
            yield batch.slice(at, rows_at_once)


def _added(study: Study, columns: Sequence[str], width: int, function, at_once: int = ROWS_IN_BATCH) -> np.ndarray:
    """The sum over all rows of ``function(batch)``, vectors of ``width``; added up in tasks, then in a tree where there are many.

    A table in files is read by a task a core: many short scans cost more by their tasks than by their rows.
    """
    rows, tasks = study.rows.select(*columns), study.rows.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            total += function(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()])], names=["place", "v"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("place")
        return pd.DataFrame({"place": [int(ordered["place"].iloc[0]) // FAN], "v": [np.sum([np.frombuffer(v) for v in ordered["v"]], axis=0).tobytes()]})

    sums = rows.mapInArrow(run, "place long, v binary")
    if not study.places:
        with arrow_rows(rows.sparkSession, at_once, tasks):
            study.places = 1 + (rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0)
    places = study.places
    while places > 1 and places * width * 8 > DIRECT_BYTES:
        sums = sums.groupBy(F.expr(f"place div {FAN}").alias("branch")).applyInPandas(merge, "place long, v binary")
        places = -(-places // FAN)
    out = np.zeros(width)
    with arrow_rows(rows.sparkSession, at_once, tasks):
        found = sums.collect()
    for r in sorted(found, key=lambda r: r["place"]):
        out += np.frombuffer(r["v"])
    return out


@dataclass
class Moments:
    """Of each part: rows, means and deviations of the columns, factor of each stratum's weights, rows of each class."""

    n: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    factor: np.ndarray
    classes: np.ndarray


_NEEDED = ["_x", "_y", "_w", "_stratum", "_slots"]


def _columns(study: Study) -> list[str]:
    return _NEEDED + (["_number", "_extra"] if study.draws else [])


def moments(study: Study) -> Moments:
    """One scan."""
    d, s, parts, draws = len(study.columns), study.strata, study.parts, study.draws
    p = len(parts)
    step = max(1, BLOCK // max(p, 2 * d + 3 + 2 * s, draws.iterations if draws else 1))

    def add(batch):
        out = np.zeros((p, 3 + 2 * d + 2 * s))
        for piece in _pieces([batch], step):
            r = _Rows(piece, d, parts, draws)
            x = r.x[:, :-1]
            own = np.zeros((len(r.y), 2 * s))
            at = np.arange(len(r.y))
            own[at, r.stratum], own[at, s + r.stratum] = r.w, 1.0
            out += r.members.T @ np.column_stack([np.ones(len(r.y)), 1 - r.y, r.y, x, x * x, own])
        return out.ravel()

    got = _added(study, _columns(study), p * (3 + 2 * d + 2 * s), add).reshape(p, -1)
    n = got[:, 0]
    safe = np.maximum(n, 1)[:, None]
    mean = got[:, 3 : 3 + d] / safe
    spread_ = np.sqrt(np.maximum(got[:, 3 + d : 3 + 2 * d] / safe - mean**2, 0))
    weight, rows = got[:, 3 + 2 * d : 3 + 2 * d + s], got[:, 3 + 2 * d + s :]
    present = (rows > 0).sum(1)[:, None]
    factor = np.where(weight > 0, n[:, None] / np.maximum(present, 1) / np.where(weight > 0, weight, 1), 0)
    return Moments(n, mean, np.where(spread_ > 1e-9, spread_, 1.0), factor, got[:, 1:3])


def crosses(study: Study, columns: Sequence[int]) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sums and cross products of ``columns`` for every (slot, value) that a ``Held`` part asks for, in one scan.

    A row adds to one value of each slot, so parts that leave one fold out cost no more
    than the folds themselves; a part's sums are those of its values.
    """
    cells = sorted({(p.slot, v) for p in study.parts if isinstance(p, Held) for v in p.values})
    own, d = list(columns), len(study.columns)
    upper = np.triu_indices(len(own))
    width = 1 + len(own) + len(upper[0])
    step = max(16, BLOCK // max(1, width))

    def add(batch):
        out = np.zeros((len(cells), width))
        for piece in _pieces([batch], step):
            r = _Rows(piece, d, [], None)
            x = r.x[:, own]
            for i, (slot, value) in enumerate(cells):
                held = x[r.slots[:, slot] == value]
                out[i, 0] += len(held)
                out[i, 1 : 1 + len(own)] += held.sum(0)
                out[i, 1 + len(own) :] += (held.T @ held)[upper]
        return out.ravel()

    got = _added(study, _NEEDED, len(cells) * width, add).reshape(len(cells), width)
    out = {}
    for cell, row in zip(cells, got, strict=True):
        full = np.zeros((len(own), len(own)))
        full[upper] = row[1 + len(own) :]
        out[cell] = (row[0], row[1 : 1 + len(own)], full + np.triu(full, 1).T)
    return out


def _components(part: Held, found: dict, order: list[int], f: Fit, m: Moments) -> np.ndarray:
    """From whitened components of a part to ``_x`` and the constant: columns are scaled, centred, turned to the axes of their correlation and divided by the axes' deviations."""
    at = [order.index(c) for c in f.embedded]
    n = sum(found[part.slot, v][0] for v in part.values)
    k = min(f.k, int(n) - 2, len(at))
    if k < 2:
        raise ValueError("too few rows or columns for components")
    mean = sum(found[part.slot, v][1] for v in part.values)[at] / n
    cross = sum(found[part.slot, v][2] for v in part.values)[np.ix_(at, at)] / n - np.outer(mean, mean)
    deviation = m.deviation[f.part, list(f.embedded)]
    values, axes = np.linalg.eigh(cross / np.outer(deviation, deviation))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    turn = np.zeros((m.mean.shape[1] + 1, k))
    turn[list(f.embedded)] = axes / deviation[:, None] / np.sqrt(np.maximum(values, 1e-24))
    turn[-1] = -mean @ turn[list(f.embedded)]
    return turn


@dataclass
class Fitted:
    """Models of a study: coefficients and constant for columns scaled within the part, and ``flat`` for ``_x`` (nought for columns left out)."""

    fits: list[Fit]
    coefficients: list[np.ndarray]
    constants: list[float]
    flat: np.ndarray
    moments: Moments
    scans: int

    def valid(self) -> np.ndarray:
        """Whether a fit's part has both classes; others are left at nought."""
        own = self.moments.classes[[f.part for f in self.fits]] if self.fits else np.zeros((0, 2))
        return (own > 0).all(1)


def fit(study: Study, fits: Sequence[Fit], steps: int = 60) -> Fitted:
    """All ``fits`` on ``study.parts``; minimises C * sum(weight * loss) + |b|**2 / 2 with the constant penalised, as ``models.Logistic``."""
    fits, d = list(fits), len(study.columns)
    m = moments(study)
    k = len(fits)
    order = sorted({c for f in fits for c in f.embedded})
    found = crosses(study, order) if order else {}
    turned: dict[tuple, np.ndarray] = {}
    turns = []  # from a fit's own coefficients to those of _x and its constant
    for f in fits:
        t = np.zeros((d + 1, len(f.columns) + 1))
        for j, c in enumerate(f.columns):
            t[c, j] = 1 / m.deviation[f.part, c]
            t[d, j] = -m.mean[f.part, c] / m.deviation[f.part, c]
        t[d, -1] = 1.0
        if f.embedded and m.classes[f.part].min() > 0:
            key = (f.part, f.embedded, f.k)
            if key not in turned:
                turned[key] = _components(study.parts[f.part], found, order, f, m)
            t = np.column_stack([t[:, :-1], turned[key], t[:, -1:]])
        turns.append(t)
    ok = (m.classes[[f.part for f in fits]] > 0).all(1) if fits else np.zeros(0, bool)
    upper = np.triu_indices(d + 1)

    def evaluate(rows, times, active, trials, wide):
        at = np.array([turns[i] @ x for i, x in zip(active, trials, strict=True)])
        for i, row, x in zip(active, times * _scan(rows, m, [fits[i] for i in active], at, wide), trials, strict=True):
            full = np.zeros((d + 1, d + 1))
            full[upper] = row[d + 2 :]
            full = full + np.triu(full, 1).T
            t, c = turns[i], fits[i].c
            yield c * row[0] + 0.5 * x @ x, c * t.T @ row[1 : d + 2] + x, c * t.T @ full @ t + np.eye(len(x))

    def along(rows, times, active, at, moves):
        both = [np.array([turns[i] @ x for i, x in zip(active, own, strict=True)]) for own in (at, moves)]
        return np.array([fits[i].c for i in active])[:, None] * times * _lengths(rows, m, [fits[i] for i in active], *both)

    hinge = np.array([f.loss == "hinge" for f in fits], bool)
    b, scans = newton([np.zeros(t.shape[1]) for t in turns], np.flatnonzero(ok & ~hinge), lambda a, x: evaluate(study, 1, a, x, SMOOTH[0]), steps, True)
    if hinge.any():
        b, more = sharpened(study, m, b, np.flatnonzero(ok & hinge), [f.part for f in fits], evaluate, along, steps)
        scans += more
    flat = np.array([t @ x for t, x in zip(turns, b, strict=True)]).reshape(k, d + 1)
    return Fitted(fits, [x[:-1] for x in b], [float(x[-1]) for x in b], flat, m, scans)


def newton(start: Sequence[np.ndarray], active: np.ndarray, evaluate, steps: int, curved: bool = False) -> tuple[list[np.ndarray], int]:
    """Minima of many functions from where they start, and the evaluations taken: ``evaluate(active, trials)`` gives value, gradient and curvature of each active one.

    A function that did not fall enough tries half its step with the others' next one,
    so all of them share every evaluation.  ``curved``: they bend everywhere alike, so a
    step that can win nothing more (a share of 1e-11) is taken without one.
    """
    b = list(start)
    trial = [x.copy() for x in b]
    now, slope, length = np.full(len(b), np.inf), np.zeros(len(b)), np.ones(len(b))
    move: list = [None] * len(b)
    taken = 0
    while len(active) and taken < steps:
        taken += 1
        left = []
        for i, (value, gradient, curvature) in zip(active, list(evaluate(active, [trial[i] for i in active])), strict=True):
            if value > now[i] - 1e-4 * length[i] * slope[i] and length[i] > 1e-8:
                length[i] /= 2
                trial[i] = b[i] - length[i] * move[i]
                left.append(i)
                continue
            done = now[i] - value <= 1e-11 * (1 + abs(value))
            b[i], now[i] = trial[i], value
            if not done:
                move[i] = np.linalg.solve(curvature, gradient)
                slope[i], length[i] = gradient @ move[i], 1.0
                trial[i] = b[i] - move[i]
                if curved and slope[i] <= 1e-11 * (1 + abs(value)):
                    b[i] = trial[i]
                    continue
                left.append(i)
        active = np.array(left, int)
    return b, taken


def sharpened(study: Study, m: Moments, start: Sequence[np.ndarray], active: np.ndarray, part: Sequence[int], evaluate, along, steps: int) -> tuple[list[np.ndarray], int]:
    """Minima of hinge losses with the last corner of SMOOTH, and the scans taken.

    ``evaluate(study, times, active, trials, wide)`` gives value, gradient and curvature
    of each active one, ``along(study, times, active, at, moves)`` its loss after each
    share of LENGTHS of its move.  A corner as sharp as the loss's own sees few rows, so
    steps by its curvature go too far; that of a wider corner, which shrinks to it step
    by step, goes about as far as the loss bends.  The best of all lengths is taken.

    The loss is convex, so the start does not change where it ends, only how soon: of a
    large table, it is worked out on some START_ROWS rows, taken by hash and counted
    ``times`` each, and then on ten times as many, and so on.  All rows take part from
    there.  Models whose part has few of these rows start on all rows.
    """
    b, shares, scans, last = list(start), np.array(LENGTHS), 0, SMOOTH[-1]

    def descend(rows, times, which, wide):
        nonlocal scans
        now, which = np.full(len(b), np.inf), list(which)
        for _ in range(steps):
            if not which:
                break
            left, values, moves = [], [], []
            for i, (value, gradient, curvature) in zip(which, list(evaluate(rows, times, which, [b[i] for i in which], wide)), strict=True):
                if wide > last or now[i] - value > 1e-11 * (1 + abs(value)):
                    left.append(i)
                    values.append(value)
                    moves.append(np.linalg.solve(curvature, gradient))
                now[i] = value
            scans += 1 + bool(left)
            which = []
            for i, value, move, found in zip(left, values, moves, along(rows, times, left, [b[i] for i in left], moves) if left else [], strict=True):
                found = found + 0.5 * np.array([(b[i] - a * move) @ (b[i] - a * move) for a in shares])
                if found.min() < value:
                    b[i] = b[i] - shares[found.argmin()] * move
                if found.min() < value or wide > last:
                    which.append(i)
            wide = max(last, NARROWED * wide)

    near, most, size, turn = np.zeros(0, int), int(m.n.max(initial=0)), START_ROWS, 0
    while len(active) and (not turn or len(near)) and most >= (2 if not turn else 4) * size:
        times = most // size
        chosen = F.pmod(F.xxhash64(*[F.col(k) for k in study.keys], "_x"), F.lit(times)) == 0
        few = replace(study, rows=written(study.rows.where(chosen)), places=0)
        if not turn:
            enough = moments(few).classes.min(1) >= START_ROWS // 100
            near = np.array([i for i in active if enough[part[i]]], int)
        descend(few, times, near, SMOOTH[min(turn, 2)])
        size, turn = 10 * size, turn + 1
    descend(study, 1, np.setdiff1d(active, near), SMOOTH[0])
    descend(study, 1, near, SMOOTH[min(turn, 2)])
    return b, scans


def losses(z: np.ndarray, y: np.ndarray, hinge: np.ndarray, wide: float = SMOOTH[-1]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and bend at margins (rows x models) of targets 0/1; ``hinge`` says which models take the smoothed hinge, which bends as in a corner of ``wide``."""
    sign = (2 * y - 1)[:, None]
    if hinge.all():
        short = 1 - sign * z
        return hinges(short), -sign * np.clip(short / SMOOTH[-1], 0, 1), ((short > 0) & (short < wide)) / wide
    small = np.exp(-np.abs(z))  # one exponential: of the likelier class the probability is 1 / (1 + small)
    one = 1 + small
    likely = 1 / one
    small *= likely
    one = np.log(one, out=one)
    one += np.maximum(-sign * z, 0)
    slope = np.where(z >= 0, likely, small)
    slope -= y[:, None]
    out = [one, slope, np.multiply(small, likely, out=likely)]
    if hinge.any():
        for x, h in zip(out, losses(z[:, hinge], y, np.ones(hinge.sum(), bool), wide), strict=True):
            x[:, hinge] = h
    return tuple(out)


def _scan(study: Study, m: Moments, fits: list[Fit], at: np.ndarray, wide: float) -> np.ndarray:
    """fits x (loss, gradient, upper half of the curvature) at coefficients of _x."""
    d, parts, draws = len(study.columns), study.parts, study.draws
    own = np.array([f.part for f in fits])
    used = np.unique(own)
    used_parts, place = [parts[i] for i in used], np.searchsorted(used, own)
    factor, hinge = m.factor[own], np.array([f.loss == "hinge" for f in fits])
    upper = np.triu_indices(d + 1)
    q = len(upper[0])
    step = max(16, BLOCK // max(len(fits), q, draws.iterations if draws else 1))
    fine = max(16, IN_CACHE // max(len(fits), q // 8))
    shared = len(fits) > 1 and (hinge == hinge[0]).all() and (at == at[0]).all()  # as at the start: margins are worked out once for all fits
    same = len(place) == len(used_parts) and (place == np.arange(len(place))).all()
    turned = np.ascontiguousarray(factor.T)

    def add(batch):
        out = np.zeros((len(fits), 1 + d + 1 + q))
        for piece in _pieces([batch], step):
            r = _Rows(piece, d, used_parts, draws)
            for begin in range(0, len(r.y), fine):  # what is worked out of a few rows stays in a core's cache
                few = slice(begin, begin + fine)
                x, y = r.x[few], r.y[few]
                w = r.members[few] if same else r.members[few][:, place]
                w = w * (turned[0] if len(turned) == 1 else turned[r.stratum[few]])
                w *= r.w[few][:, None]
                loss, slope, bend = losses(x @ (at[:1] if shared else at).T, y, hinge[:1] if shared else hinge, wide)
                if shared:
                    out[:, : d + 2] += w.T @ np.column_stack([loss, slope * x])
                    bend = w * bend
                else:
                    loss *= w
                    slope *= w
                    bend = bend * w
                    out[:, 0] += loss.sum(0)
                    out[:, 1 : d + 2] += slope.T @ x
                if hinge.all():  # few rows lie in the corner of a hinge
                    bent = np.flatnonzero(bend.any(1))
                    x, bend = x[bent], bend[bent]
                across = np.ascontiguousarray(x.T)
                out[:, d + 2 :] += bend.T @ (across[upper[0]] * across[upper[1]]).T
        return out.ravel()

    return _added(study, _columns(study), len(fits) * (1 + d + 1 + q), add).reshape(len(fits), -1)


def hinges(short: np.ndarray) -> np.ndarray:
    """Smoothed hinge losses of margins that are short of 1 by so much."""
    steep = np.clip(short / SMOOTH[-1], 0, 1)
    short = short - SMOOTH[-1] / 2 * steep
    short *= steep
    return short


def _lengths(study: Study, m: Moments, fits: list[Fit], at: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """fits x LENGTHS: weighted hinge losses at coefficients of _x less each share of a move."""
    d, own = len(study.columns), np.array([f.part for f in fits])
    used = np.unique(own)
    parts, place, turned = [study.parts[i] for i in used], np.searchsorted(used, own), np.ascontiguousarray(m.factor[own].T)
    step, fine = max(16, BLOCK // len(fits)), max(16, IN_CACHE // len(fits))

    def add(batch):
        out = np.zeros((len(fits), len(LENGTHS)))
        for piece in _pieces([batch], step):
            r = _Rows(piece, d, parts, None)
            for begin in range(0, len(r.y), fine):
                few = slice(begin, begin + fine)
                w = r.members[few][:, place] * turned[r.stratum[few]] * r.w[few][:, None]
                sign = (2 * r.y[few] - 1)[:, None]
                short, gained = 1 - sign * (r.x[few] @ at.T), sign * (r.x[few] @ moves.T)
                for j, a in enumerate(LENGTHS):
                    out[:, j] += np.einsum("ij,ij->j", w, hinges(short + a * gained))
        return out.ravel()

    return _added(study, _columns(study), len(fits) * len(LENGTHS), add).reshape(len(fits), -1)


def predict(study: Study, fitted: Fitted, tests: Sequence[tuple[int, int]]) -> DataFrame:
    """fit, the study's keys, target, probability, weight: of each (fit, part) the rows of the part; fits without both classes give none.

    A hinge model's ``probability`` is its margin.  The weight is the row's in that part (strata alike, as in training).  One scan; a
    row comes out once for each test that it takes part in.
    """
    valid = fitted.valid()
    tests = [(i, p) for i, p in tests if valid[i]]
    d, keys, target = len(study.columns), study.keys, study.target
    schema = T.StructType([T.StructField("fit", T.IntegerType()), *[study.rows.schema[c] for c in keys], T.StructField(target, T.IntegerType()), T.StructField("probability", T.DoubleType()), T.StructField("weight", T.DoubleType())])
    which, parts = np.array([i for i, _ in tests], np.int32), [study.parts[p] for _, p in tests]
    flat = fitted.flat[which] if tests else np.zeros((0, d + 1))
    factor = fitted.moments.factor[[p for _, p in tests]] if tests else np.zeros((0, 1))
    margins = np.array([fitted.fits[i].loss == "hinge" for i, _ in tests], bool)
    step = max(16, BLOCK // max(len(tests), 1))
    n = len(keys)

    def run(batches):
        for piece in _pieces(batches, step):
            if not parts:
                return
            r = _Rows(piece.select(_NEEDED), d, parts, None)
            row, test = np.nonzero(r.members)
            p = np.einsum("ij,ij->i", r.x[row], flat[test])
            p = np.where(margins[test], p, sigmoid(p))
            w = r.members[row, test] * factor[test, r.stratum[row]] * r.w[row]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(which[test]), *[piece.column(i).take(at) for i in range(n + 1)], pa.array(p), pa.array(w)], names=schema.names)

    return study.rows.select(*keys, target, *_NEEDED).mapInArrow(run, schema)


def _tested(study: Study, fitted: Fitted, tests: Sequence[tuple[int, int]], weight: str | None):
    """Rows with what their tests need, and a function from a batch to (test, score, target, weight) of every row that takes part, a piece at a time."""
    d, parts = len(study.columns), [study.parts[p] for _, p in tests]
    flat, factor = fitted.flat[[i for i, _ in tests]], fitted.moments.factor[[p for _, p in tests]]
    margins = np.array([fitted.fits[i].loss == "hinge" for i, _ in tests], bool)
    step = max(16, BLOCK // max(len(tests), 1))

    def run(batches):
        for piece in _pieces(batches, step):
            r = _Rows(piece.select(_NEEDED), d, parts, None)
            row, test = np.nonzero(r.members)
            p = np.einsum("ij,ij->i", r.x[row], flat[test])
            p = np.where(margins[test], p, sigmoid(p))
            w = piece.column(len(_NEEDED)).to_numpy()[row] if weight else r.members[row, test] * factor[test, r.stratum[row]] * r.w[row]
            yield test, p, r.y[row], w

    return study.rows.select(*_NEEDED, *([weight] if weight else [])), run


def collapsed(score: np.ndarray, wp: np.ndarray, wn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of equal scores added up, scores rising."""
    order = np.argsort(score)
    score = score[order]
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]])) if len(score) else np.zeros(0, int)
    if len(first) == len(score):
        return score, wp[order], wn[order]
    return score[first], *[np.add.reduceat(w[order], first) for w in (wp, wn)]


def packed_weights(w: np.ndarray) -> bytes:
    """Weights as bytes: those of one part in a whole number by that number, noughts between as bits, where that gives them back exactly."""
    some = w != 0
    own = w[some]
    with np.errstate(all="ignore"):
        parts = np.rint(1 / own)
    if len(own) and not (parts.max() < 256 and parts.min() > 0 and (1 / parts == own).all()):
        return w.tobytes()
    return np.packbits(some).tobytes() + parts.astype(np.uint8).tobytes()


def unpacked_weights(data, n: int) -> np.ndarray:
    """``n`` weights of ``packed_weights``; as they are they take more bytes than packed ones can."""
    if len(data) == 8 * n:
        return np.frombuffer(data)
    bits = -(-n // 8)
    data = np.frombuffer(data, np.uint8)
    out = np.zeros(n)
    out[np.unpackbits(data[:bits], count=n).view(bool)] = 1 / data[bits:].astype(np.float64)
    return out


def aucs(study: Study, fitted: Fitted, tests: Sequence[tuple[int, int]], labels: dict[str, Sequence], weight: str | None = None) -> DataFrame:
    """The labels and auc, the weighted share of (positive, negative) pairs in order, of each cohort: the rows of all tests (fit, part) whose fits have equal labels.

    As ``metrics.auc`` over ``predict``, without a row for each score: a task sorts its
    scores of a cohort, adds up equal ones and hands them on as arrays, cut into
    stretches of some ROWS_IN_STRETCH rows at quantiles of the tasks' scores; a
    stretch's arrays are merged in a task.  ``weight`` is a key of the study, by
    default the row's weight in the part.
    """
    spark, valid = study.rows.sparkSession, fitted.valid()
    tests = [(i, p) for i, p in tests if valid[i]]
    names = list(labels)
    cohorts = sorted({tuple(labels[n][i] for n in names) for i, _ in tests})
    place = np.array([cohorts.index(tuple(labels[n][i] for n in names)) for i, _ in tests], np.int64)
    kind = {int: "int", float: "double", str: "string"}
    kinds = ", ".join(f"{n} {kind[type(labels[n][0])] if len(labels[n]) else 'int'}" for n in names)
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(cohorts)], f"_cohort int, {kinds}")
    rows, scored = _tested(study, fitted, tests, weight)
    cuts: list[np.ndarray] = [np.zeros(0)] * len(cohorts)
    stretches = -(-int(fitted.moments.n.max(initial=0)) // ROWS_IN_STRETCH)

    def kept(batches):
        """Scores of each cohort with the weights of positives and negatives, some KEPT at a time."""
        own: list[tuple] = []
        size = 0

        def out():
            test, p, y, w = (np.concatenate(x) for x in zip(*own, strict=True))
            at = place[test]
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(cohorts) + 1))
            for k in range(len(cohorts)):
                mine = order[ends[k] : ends[k + 1]]
                if len(mine):
                    yield k, len(mine), collapsed(p[mine], w[mine] * (y[mine] == 1), w[mine] * (y[mine] == 0))

        for found in scored(batches):
            own.append(found)
            size += len(found[0])
            if size >= KEPT:
                yield from out()
                own, size = [], 0
        if size:
            yield from out()

    if stretches > 1 and tests:

        def quantiles(batches):
            for k, n, (score, _, _) in kept(batches):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([score[(np.arange(QUANTILES) * len(score)) // QUANTILES].tobytes()])], names=["k", "n", "q"])

        sketch: list[list] = [[] for _ in cohorts]
        for r in rows.mapInArrow(quantiles, "k int, n long, q binary").collect():
            sketch[r["k"]].append((np.frombuffer(r["q"]), r["n"]))
        for k, got in enumerate(sketch):
            value, n = np.concatenate([q for q, _ in got]), np.concatenate([np.full(QUANTILES, m / QUANTILES) for _, m in got])
            order = np.argsort(value, kind="stable")
            ahead = np.cumsum(n[order])
            cuts[k] = np.unique(value[order][np.minimum(np.searchsorted(ahead, ahead[-1] * np.arange(1, stretches) / stretches), len(order) - 1)])

    def cut(batches):
        for k, _, (score, wp, wn) in kept(batches):
            ends = np.concatenate([[0], np.searchsorted(score, cuts[k]), [len(score)]])
            for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), pa.array([score[a:b].tobytes()]), *[pa.array([packed_weights(x[a:b])]) for x in (wp, wn)]], names=["_cohort", "_stretch", "score", "wp", "wn"])

    def merged(arrays: pa.Table) -> pa.Table:
        score, *weights = ([v.as_buffer() for v in arrays[c]] for c in ("score", "wp", "wn"))
        score = [np.frombuffer(v) for v in score]
        score, wp, wn = collapsed(np.concatenate(score), *[np.concatenate([unpacked_weights(v, len(x)) for v, x in zip(w, score, strict=True)]) for w in weights])
        won = float((wp * (np.cumsum(wn) - wn / 2)).sum())
        return pa.table({"_cohort": arrays["_cohort"][:1], "_stretch": arrays["_stretch"][:1], "wp": pa.array([float(wp.sum())]), "wn": pa.array([float(wn.sum())]), "won": pa.array([won])})

    parts = rows.mapInArrow(cut, "_cohort int, _stretch int, score binary, wp binary, wn binary")
    sums = parts.groupBy("_cohort", "_stretch").applyInArrow(merged, "_cohort int, _stretch int, wp double, wn double, won double")
    ahead = Window.partitionBy("_cohort").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("wn").over(ahead), F.lit(0.0)))
    pairs = F.sum("wp") * F.sum("wn")
    each = sums.groupBy("_cohort").agg(F.when(pairs > 0, F.sum(F.col("won") + F.col("wp") * F.col("_ahead")) / pairs).alias("auc"))
    return each.join(F.broadcast(table), "_cohort").select(*names, "auc")


def labelled(frame: DataFrame, fits: Sequence[Fit], **columns: Sequence) -> DataFrame:
    """``frame`` (of ``predict``) with columns that each fit has a value of, in place of ``fit``; the table of fits has a bounded size."""
    names = list(columns)
    kind = {int: "int", float: "double", str: "string"}
    kinds = "fit int, " + ", ".join(f"{n} {kind[type(columns[n][0])] if len(columns[n]) else 'int'}" for n in names)
    rows = [(i, *[columns[n][i] for n in names]) for i in range(len(fits))]
    table = frame.sparkSession.createDataFrame(rows, kinds)
    return frame.join(F.broadcast(table), "fit").drop("fit")
