"""Kernel machines over tables of any size: a landmark map and a distributed hinge fit.

The kernel of two rows is approximated by that of their nearest structure among a
bounded number of landmarks (the Nystroem map): rows become r numbers whose inner
products are exact between landmarks.  A machine is then linear in these numbers and
is fitted by the shared scans of ``batched`` -- no row meets another, and all rows
take part.  Scaling, width of the kernel and landmarks are those of the training part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.operators import batched
from lumenlake.operators.batched import Study, _added, _columns, _pieces, _Rows, losses, moments

#: Landmarks of a machine, and rows that they are chosen from (those of the least hash).
LANDMARKS, CANDIDATES = 200, 4000
#: Kernel values that a task works on at once; they fit a core's cache.
IN_CACHE = 160_000


@dataclass(frozen=True)
class Machine:
    """A part, C, and the kernel's width: a number, or "scale" for 1 / (columns * variance)."""

    part: int
    c: float
    gamma: float | str = "scale"


@dataclass
class Map:
    """Rows of ``_x`` to numbers whose inner products approximate the kernel."""

    mean: np.ndarray
    deviation: np.ndarray
    points: np.ndarray
    gamma: float
    turn: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """The exponents are one product of matrices."""
        own = np.vstack([2 * self.points.T, np.full(len(self.points), -1.0), -(self.points * self.points).sum(1)]) * self.gamma
        out = np.column_stack([x, (x * x).sum(1), np.ones(len(x))]) @ own
        np.minimum(out, 0, out=out)
        return np.exp(out, out=out)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The kernel with each landmark, before it is turned."""
        return self.kernel((x - self.mean) / self.deviation)

    @property
    def size(self) -> int:
        """Landmarks, and one for the constant."""
        return len(self.points) + 1

    def turns(self) -> np.ndarray:
        """From ``raw`` with a column of ones to features: the constant is one of the kernel's."""
        out = np.zeros((self.size, self.turn.shape[1] + 1))
        out[:-1, :-1], out[-1, -1] = self.turn, 1.0
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """One column more, of ones: the constant is a feature of the kernel."""
        return np.column_stack([self.raw(x) @ self.turn, np.ones(len(x))])


def landmark_map(points: np.ndarray, mean: np.ndarray, deviation: np.ndarray, gamma: float | str) -> Map:
    scaled = (points - mean) / deviation
    width = 1.0 / (scaled.shape[1] * max(scaled.var(), 1e-12)) if gamma == "scale" else float(gamma)
    own = Map(mean, deviation, scaled, width, np.zeros((0, 0)))
    values, axes = np.linalg.eigh(own.kernel(scaled))
    keep = values > 1e-10 * max(values.max(initial=0), 1e-300)
    own.turn = axes[:, keep] / np.sqrt(values[keep])
    return own


@dataclass
class Machines:
    machines: list[Machine]
    maps: list[Map | None]
    weights: list[np.ndarray]
    moments: batched.Moments
    scans: int


def fit(study: Study, machines: Sequence[Machine], landmarks: int = LANDMARKS, candidates: int = CANDIDATES, steps: int = 80) -> Machines:
    """All machines on ``study.parts`` (of kind ``Held``); minimises C * sum(weight * hinge) + |weights|**2 / 2 over all rows of the part.

    The driver gets ``candidates`` rows.  A part without both classes has no machine.
    """
    machines, m = list(machines), moments(study)
    seed = F.xxhash64(*[F.col(k) for k in study.keys], "_x")
    sample = study.rows.select("_x", "_slots", seed.alias("_h")).orderBy("_h").limit(candidates).collect()
    x, slots = np.array([r["_x"] for r in sample], float).reshape(len(sample), len(study.columns)), np.array([r["_slots"] for r in sample]).reshape(len(sample), -1)
    maps: list[Map | None] = []
    made: dict[tuple, Map] = {}
    for one in machines:
        part = study.parts[one.part]
        own = x[np.isin(slots[:, part.slot], part.values)][:landmarks] if len(x) else x
        if not len(own) or m.classes[one.part].min() == 0:
            maps.append(None)
            continue
        key = (one.part, one.gamma)
        if key not in made:
            made[key] = landmark_map(own, m.mean[one.part], m.deviation[one.part], one.gamma)
        maps.append(made[key])
    sizes = [p.turn.shape[1] + 1 if p else 0 for p in maps]

    def scan(rows, active, sizes, function):
        """Sums of ``function(features, target, weight, k, out)`` over all rows, ``sizes`` numbers for each active machine; machines of a part and width share the features."""
        ends, used = np.cumsum([0, *sizes]), sorted({machines[i].part for i in active})
        parts, factor, d = [study.parts[p] for p in used], m.factor, len(study.columns)
        step, fine = (max(16, n // max(maps[i].size for i in active)) for n in (batched.BLOCK, IN_CACHE))
        together: dict[tuple, list[int]] = {}
        for k, i in enumerate(active):
            together.setdefault((machines[i].part, machines[i].gamma), []).append(k)
        shared = [(used.index(part), factor[part], maps[active[own[0]]], own) for (part, _), own in together.items()]

        def add(batch):
            out = np.zeros(ends[-1])
            for piece in _pieces([batch], step):
                r = _Rows(piece, d, parts, None)
                for place, weigh, p, own in shared:
                    taking = np.flatnonzero(r.members[:, place])
                    x, y, w = r.x[taking, :-1], r.y[taking], r.w[taking] * weigh[r.stratum[taking]]
                    for begin in range(0, len(taking), fine):
                        few = slice(begin, begin + fine)
                        features = p.raw(x[few])
                        for k in own:
                            function(features, y[few], w[few], k, out[ends[k] : ends[k + 1]])
            return out

        got = _added(rows, _columns(rows), ends[-1], add)
        return [got[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def evaluate(rows, times, active, trials, wide):
        at = [(maps[i].turn @ t[:-1], t[-1]) for i, t in zip(active, trials, strict=True)]

        def add(features, y, w, k, out):
            # the kernel is not turned row by row: what is added up is turned by the driver
            (turned, constant), n = at[k], features.shape[1] + 1
            loss, slope, bend = (v[:, 0] for v in losses((features @ turned + constant)[:, None], y, np.ones(1, bool), wide))
            pull = w * slope
            out[0] += (w * loss).sum()
            out[1 : 1 + n] += np.append(pull @ features, pull.sum())
            curved = np.flatnonzero(bend)
            near, curve = np.column_stack([features[curved], np.ones(len(curved))]), (w * bend)[curved]
            out[1 + n :] += ((near * curve[:, None]).T @ near).ravel()

        for i, t, row in zip(active, trials, scan(rows, active, [1 + maps[i].size + maps[i].size ** 2 for i in active], add), strict=True):
            n, c, turn = maps[i].size, machines[i].c * times, maps[i].turns()
            yield c * row[0] + 0.5 * t @ t, c * turn.T @ row[1 : 1 + n] + t, c * turn.T @ row[1 + n :].reshape(n, n) @ turn + np.eye(len(t))

    def along(rows, times, active, at, moves):
        pairs = [(maps[i].turn @ np.column_stack([t[:-1], x[:-1]]), t[-1], x[-1]) for i, t, x in zip(active, at, moves, strict=True)]

        def add(features, y, w, k, out):
            turned, constant, more = pairs[k]
            sign, margins = 2 * y - 1, features @ turned
            short, gained = 1 - sign * (margins[:, 0] + constant), sign * (margins[:, 1] + more)
            out += [w @ batched.hinges(short + a * gained) for a in batched.LENGTHS]

        return np.array([machines[i].c * times * row for i, row in zip(active, scan(rows, active, [len(batched.LENGTHS)] * len(active), add), strict=True)])

    found = np.array([i for i, p in enumerate(maps) if p], int)
    weights, scans = batched.sharpened(study, m, [np.zeros(n) for n in sizes], found, [one.part for one in machines], evaluate, along, steps)
    return Machines(machines, maps, weights, m, scans)


def predict(study: Study, fitted: Machines, tests: Sequence[tuple[int, int]]) -> DataFrame:
    """fit, the study's keys, target, probability (the margin) of each (machine, part): the part's rows; machines without both classes give none."""
    tests = [(i, p) for i, p in tests if fitted.maps[i]]
    parts, d, keys = [study.parts[p] for _, p in tests], len(study.columns), study.keys
    n, step = len(keys), max(16, IN_CACHE // LANDMARKS)
    own = [(i, fitted.maps[i], fitted.weights[i]) for i, _ in tests]
    schema = T.StructType([T.StructField("fit", T.IntegerType()), *[study.rows.schema[c] for c in keys], T.StructField(study.target, T.IntegerType()), T.StructField("probability", T.DoubleType())])

    def run(batches):
        for piece in _pieces(batches, step):
            r = _Rows(piece.select(batched._NEEDED), d, parts, None)
            for j, (i, p, w) in enumerate(own):
                at = np.flatnonzero(r.members[:, j])
                if len(at):
                    z = p.raw(r.x[at][:, :-1]) @ (p.turn @ w[:-1]) + w[-1]
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), *[piece.column(c).take(rows) for c in range(n + 1)], pa.array(z)], names=schema.names)

    return study.rows.select(*keys, study.target, *batched._NEEDED).mapInArrow(run, schema)
