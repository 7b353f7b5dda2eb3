"""Ensembles of trees over tables of any size, many of them at once.

Rows are turned to bin numbers once, by cut points of the training part, and written in
blocks, a record each: columns of bytes that a task reads without a step for each row
and that its compares go over whole while they stay in a core's cache.  A scan then
adds up, in every task, histograms of gradient, weight and rows for all open nodes of
all trees that grow at the time, over the columns each node may split by; the driver
picks the splits and the next scan serves their children.  No row is gathered or
shuffled.  Forests grow their trees side by side; boosted ensembles of all fits go
through their rounds together, and what the finished rounds give a row is written with
the row from time to time.

Growth by best leaf first needs the gains of both children before the next leaf is
chosen.  Children of all leaves that may still be chosen are therefore counted in one
scan, and the order is replayed on the driver: the tree is exactly that of one split at
a time, in about as many scans as it is deep.

The driver holds the models and at most ``MOST_SUMS`` histogram numbers of a scan.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.models import sigmoid
from lumenlake.operators import batched
from lumenlake.operators.batched import Held, Study, _added, _pieces, _Rows, moments
from lumenlake.operators.bootstrap import OF_UNIT, hashed
from lumenlake.session import arrow_rows, remove, shared_dir

#: Bins of a column (a byte holds their numbers), and values that a quantile sketch keeps.
BINS, ACCURACY = 64, 10_000
#: Histogram numbers of a scan.
MOST_SUMS = 2_000_000
#: Rounds of boosting between two writings of the rows, and splits of a model's trees that a row goes through before.
REFRESH, SPLITS = 16, 48
#: Rows of a block, bytes of its bins, rows that a task works on at once, and blocks of an Arrow batch.
ROWS_IN_BLOCK, BLOCK_BYTES, FINE, BLOCKS_AT_ONCE = 1 << 16, 8 << 20, 1 << 14, 8
#: Gains that differ by less than this share are ties: the first column and cut win.
TIE = 1e-9
#: Distribution of a Poisson number of mean 1, as 32-bit thresholds.
_POISSON = np.floor(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])) * 2.0**32)

#: The number by the upper half of a hash, -1 where it depends on the lower one.
_POISSON_OF = np.searchsorted(_POISSON, np.arange(1 << 16) * 65536.0, "right").astype(np.int8)
_POISSON_OF[_POISSON_OF != np.searchsorted(_POISSON, np.arange(1 << 16) * 65536.0 + 65535, "right")] = -1


@dataclass(frozen=True)
class Ensemble:
    """A model of a part: ``forest`` (bagged), ``extra`` (whole samples, one random cut a column), ``boosted`` (logistic loss) or ``adaptive`` (two-class SAMME).

    ``share`` of the columns is drawn at each node; a leaf holds ``leaf`` rows or more;
    ``leaves`` bounds their number, the best split first; ``ridge`` is the l2 penalty
    of leaf values.  Classes weigh alike, in each drawn sample of its own.
    """

    part: int
    kind: str = "forest"
    trees: int = 500
    share: float | str = 1.0
    leaf: int = 1
    depth: int = 30
    leaves: int | None = None
    rate: float = 0.1
    ridge: float = 0.0
    seed: int = 20260717

    @property
    def sequential(self) -> bool:
        return self.kind in ("boosted", "adaptive")

    def drawn(self, columns: int) -> int:
        share = 1 / np.sqrt(columns) if self.share == "sqrt" else float(self.share)
        return max(1, int(round(share * columns)))


@dataclass
class Grown:
    """A tree as arrays: column (-1 at a leaf), cut (greatest bin that goes left), children, value."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        return self.reached(np.ascontiguousarray(bins.T))

    def reached(self, codes: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every row of ``codes`` (columns x rows), or of some rows.

        Through a tree of few splits all rows are compared with each, whole columns of
        bytes at a time; through others the rows go down together, a level at a time.
        """
        m = codes.shape[1]
        inner = np.flatnonzero(self.column >= 0)  # parents come first
        depth = self.depth()
        if len(inner) > 8 * max(depth, 1) or len(self.column) > 256:
            own = np.arange(len(self.column))
            column, cut = np.where(self.column >= 0, self.column, 0).astype(np.intp) * m, self.cut.astype(codes.dtype)
            to = np.stack([np.where(self.column >= 0, self.left, own), np.where(self.column >= 0, self.right, own)], axis=1).ravel().astype(np.intp)
            flat, start = codes.ravel(), np.arange(m) if rows is None else rows
            node = np.zeros(len(start), np.intp)
            for _ in range(depth):
                right = flat.take(start + column.take(node)) > cut.take(node)
                node += node
                node += right
                node = to.take(node)
            return node
        node = np.zeros(m, np.uint8)
        for v in inner:
            step = (codes[self.column[v]] > self.cut[v]).view(np.uint8)
            step = step * np.uint8(self.right[v] - self.left[v])
            step += np.uint8(self.left[v] - v)
            if v:
                step *= (node == v).view(np.uint8)
            node += step
        return (node if rows is None else node[rows]).astype(np.intp)

    def depth(self) -> int:
        level = np.zeros(len(self.column), int)
        for v in np.flatnonzero(self.column >= 0):  # children come after their parent
            level[[self.left[v], self.right[v]]] = level[v] + 1
        return int(level.max())

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Values of the rows of ``codes``, columns x rows."""
        return self.value.take(self.reached(codes))


def times(rows: np.ndarray, one: Ensemble, tree: int) -> np.ndarray:
    """How often a tree's sample has each row (given by its hash): a Poisson number of mean 1, or 1 where samples are whole."""
    return _drawn(rows, one, tree).astype(np.float64) if one.kind == "forest" else np.ones(len(rows))


def _drawn(rows: np.ndarray, one: Ensemble, tree: int) -> np.ndarray:
    """``times`` of a bagged tree, as bytes."""
    h = hashed(rows.astype(np.uint64, copy=False), OF_UNIT, one.seed + 7919 * tree)
    out = _POISSON_OF.take(h >> np.uint32(16))
    open_ = np.flatnonzero(out < 0)
    out[open_] = np.searchsorted(_POISSON, h[open_].astype(np.float64), "right")
    return out


def columns_of(node: int, one: Ensemble, tree: int, columns: int) -> np.ndarray:
    """The columns that a node may split by, drawn by hash."""
    m = one.drawn(columns)
    if m >= columns:
        return np.arange(columns)
    return np.sort(np.argsort(hashed(np.arange(columns, dtype=np.uint64) + np.uint64(node << 12), OF_UNIT, one.seed + 7919 * tree + 1), kind="stable")[:m])


def cuts_of(node: int, one: Ensemble, tree: int, columns: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A random cut of each column between its least and greatest bin in the node."""
    h = hashed(columns.astype(np.uint64) + np.uint64(node << 12), OF_UNIT, one.seed + 7919 * tree + 2).astype(np.float64) / 2.0**32
    return low + (h * (high - low)).astype(int)


@dataclass
class _Growing:
    """A tree whose nodes (1, and 2k, 2k + 1 below k) are known by sums (gradient, weight, rows) and best split."""

    one: Ensemble
    fit: int
    number: int
    columns: int
    sums: dict = field(default_factory=dict)
    #: of each counted node: (gain, column, cut), or nothing where it stays a leaf
    best: dict = field(default_factory=dict)
    accepted: list = field(default_factory=list)
    wanted: list = field(default_factory=lambda: [1])

    def absorb(self, node: int, columns: np.ndarray, counts: np.ndarray) -> None:
        """``counts``: columns x bins x (gradient, weight, rows)."""
        one, ridge = self.one, self.one.ridge
        total = counts[0].sum(0)
        self.sums.setdefault(node, total)
        g, h, n = self.sums[node]
        if self._closed(node):
            self.best[node] = None
            return
        low = counts.cumsum(1)
        lg, lh, ln = low[..., 0], low[..., 1], low[..., 2]
        ok = (ln >= one.leaf) & (n - ln >= one.leaf) & (lh > 0) & (h - lh > 0)
        if one.kind == "extra":
            filled = counts[..., 2] > 0
            first, last = filled.argmax(1), counts.shape[1] - 1 - filled[:, ::-1].argmax(1)
            only = np.zeros_like(ok)
            only[np.arange(len(columns)), cuts_of(node, one, self.number, columns, first, last)] = True
            ok &= only
        own = g * g / (h + ridge)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, lg**2 / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - own, -np.inf)
        top = gain.max()
        if not top > 1e-12 + 1e-10 * abs(own):
            self.best[node] = None
            return
        at = int(np.flatnonzero(gain.ravel() >= top - TIE * abs(top))[0])
        i, cut = divmod(at, counts.shape[1])
        self.best[node] = (float(gain[i, cut]), int(columns[i]), cut)
        self.sums[2 * node] = low[i, cut]
        self.sums[2 * node + 1] = self.sums[node] - low[i, cut]
        for child in (2 * node, 2 * node + 1):
            if self._closed(child):
                self.best[child] = None

    def _closed(self, node: int) -> bool:
        g, h, n = self.sums[node]
        pure = self.one.kind in ("forest", "extra") and (g <= 1e-9 * h or g >= (1 - 1e-9) * h)
        return node.bit_length() - 1 >= self.one.depth or n < max(2, 2 * self.one.leaf) or h <= 0 or pure

    def replay(self) -> None:
        """Splits in the order of their gains, as far as they are known, and the nodes that must be counted to go on."""
        most = self.one.leaves or float("inf")
        self.accepted, wanted, size = [], [], 1
        if 1 not in self.best:
            self.wanted = [1]
            return
        heap = [(-self.best[1][0], 1)] if self.best[1] else []
        while heap and size < most and not (wanted and self.one.leaves):
            _, node = heapq.heappop(heap)
            self.accepted.append(node)
            size += 1
            for child in (2 * node, 2 * node + 1):
                if child not in self.best:
                    wanted.append(child)
                elif self.best[child]:
                    heapq.heappush(heap, (-self.best[child][0], child))
        if size >= most:
            wanted = []
        elif wanted and self.one.leaves:
            # leaves that may be chosen next: their children are counted in the same scan
            for _, node in heapq.nsmallest(int(most - size), heap):
                wanted += [c for c in (2 * node, 2 * node + 1) if c not in self.best]
        self.wanted = wanted

    def arrays(self, splits: Sequence[int], value) -> tuple[Grown, dict[int, int]]:
        splits = set(splits)
        order, at = [1], 0
        while at < len(order):
            if order[at] in splits:
                order += [2 * order[at], 2 * order[at] + 1]
            at += 1
        place = {node: i for i, node in enumerate(order)}
        parts = [(self.best[v][1], self.best[v][2], place[2 * v], place[2 * v + 1]) if v in splits else (-1, 0, -1, -1) for v in order]
        column, cut, left, right = (np.array(c, np.int32) for c in zip(*parts, strict=True))
        return Grown(column, cut, left, right, np.array([value(self.sums[v]) if v in self.sums else 0.0 for v in order])), place

    def reached(self) -> tuple[Grown, dict[int, int]]:
        """The tree with every known split, for rows on their way to the wanted nodes."""
        return self.arrays([v for v, b in self.best.items() if b], lambda s: 0.0)

    def grown(self) -> Grown:
        return self.arrays(self.accepted, lambda s: s[0] / (s[1] + self.one.ridge) if s[1] + self.one.ridge > 0 else 0.0)[0]


@dataclass
class Ensembles:
    """Models: the trees of each ensemble, cut points of each part, and votes of an adaptive one (classes weigh alike, so the constant is 0)."""

    ensembles: list[Ensemble]
    trees: list[list[Grown]]
    edges: dict[int, list[np.ndarray]]
    votes: list[list[float]]
    fitted: list[bool]
    scans: int = 0

    def score(self, i: int, codes: np.ndarray) -> np.ndarray:
        """Of rows given by their bins, columns x rows."""
        one, trees = self.ensembles[i], self.trees[i]
        total = np.zeros(codes.shape[1])
        for begin in range(0, len(total), FINE):
            few, own = np.ascontiguousarray(codes[:, begin : begin + FINE]), total[begin : begin + FINE]
            for k, tree in enumerate(trees):
                own += self.votes[i][k] * np.where(tree(few) >= 0, 1.0, -1.0) if one.kind == "adaptive" else tree(few)
        if one.kind == "boosted":
            return sigmoid(one.rate * total)
        if one.kind == "adaptive":
            return 0.5 + 0.5 * total / (sum(self.votes[i]) or 1.0)
        return total / max(len(trees), 1)


def cut_points(study: Study, part: Held, bins: int = BINS) -> list[np.ndarray]:
    """Quantiles of each column among the rows of a part, from mergeable sketches in one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    member = F.element_at("_slots", part.slot + 1).isin(list(part.values))
    got = study.rows.where(member).agg(*[F.percentile_approx(F.element_at("_x", j + 1), shares, ACCURACY).alias(f"q{j}") for j in range(len(study.columns))]).first()
    return [np.unique(q) if q else np.zeros(0) for q in got]


def coded(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers, columns x rows."""
    return np.array([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], np.uint8).reshape(len(edges), len(x))


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(coded(x, edges).T)


#: A block of rows: hashes, targets, weights (none where all are 1), strata, whether they lie in each fitted part, its bins (part, column, row), and what finished rounds gave (model, row).
_KINDS = {"_h": np.int64, "_y": np.uint8, "_w": np.float64, "_stratum": np.int16, "_m": np.uint8, "_b": np.uint8, "_z": np.float64}
_NAMES = list(_KINDS)
_ROW = ", ".join(f"{n} binary" for n in _NAMES)


def _packed(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(np.arange(0, (len(matrix) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(matrix) + 1, np.int32)), pa.py_buffer(matrix)])


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return values.view(kind).reshape(len(column), -1) if len(column) and len(values) else np.zeros((len(column), 0), kind)


def _record(block: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_packed(np.asarray(block[n], kind).reshape(1, -1)) for n, kind in _KINDS.items()], names=_NAMES)


def _blocks(batch: pa.RecordBatch, parts: int, d: int):
    """The blocks of a batch as matrices."""
    for at in range(batch.num_rows):
        r = {n: _unpacked(batch.column(i).slice(at, 1), _KINDS[n])[0] for i, n in enumerate(batch.schema.names)}
        m = len(r["_y"])
        shapes = {"_m": (parts, m), "_b": (parts, d, m), "_z": (-1, m)}
        yield r | {n: r[n].reshape(shape) for n, shape in shapes.items() if n in r} | ({} if len(r["_w"]) else {"_w": np.ones(m)})


def _part(block: dict, begin: int, end: int) -> dict:
    """Some rows of a block; bins are copied, since columns are read many times."""
    return {n: np.ascontiguousarray(v[..., begin:end]) if n == "_b" else v[..., begin:end] for n, v in block.items()}


class _Table:
    """The study's rows as blocks of bins of every part that is fitted, and what finished rounds gave each row (``_z``)."""

    def __init__(self, study: Study, edges: dict[int, list[np.ndarray]], models: int, needed: Sequence[str] = _NAMES):
        """``needed``: columns of the blocks that scans read."""
        order, d, parts = sorted(edges), len(study.columns), study.parts
        cuts, held = [edges[p] for p in order], [parts[p] for p in order]
        room = max(256, min(ROWS_IN_BLOCK, BLOCK_BYTES // (d * len(cuts))))

        def made(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            piece = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
            r = _Rows(piece.select(batched._NEEDED), d, held, None)
            codes = [coded(r.x[:, :-1], e) for e in cuts]
            return _record({"_h": piece.column(len(batched._NEEDED)).to_numpy(), "_y": r.y, "_w": r.w if (r.w != 1).any() else r.w[:0], "_stratum": r.stratum, "_m": r.members.T, "_b": codes, "_z": np.zeros((models, len(r.y)))})

        def run(batches):
            kept, size = [], 0
            for piece in _pieces(batches, room):
                kept.append(piece)
                size += piece.num_rows
                while size >= room:
                    size -= room
                    last = kept.pop()
                    yield made([*kept, last.slice(0, last.num_rows - size)])
                    kept = [last.slice(last.num_rows - size)] if size else []
            if size:
                yield made(kept)

        seed = F.xxhash64(*[F.col(k) for k in study.keys], "_x")
        self.study, self.path, self.place, self.d, self.needed = study, None, {p: i for i, p in enumerate(order)}, d, list(needed)
        self._write(study.rows.select(*batched._NEEDED, seed.alias("_h")).mapInArrow(run, _ROW))

    def _write(self, rows: DataFrame) -> None:
        spark, before = self.study.rows.sparkSession, self.path
        self.path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
        with arrow_rows(spark, BLOCKS_AT_ONCE if before else batched.ROWS_IN_BATCH):
            rows.write.options(**{"compression": "lz4", "parquet.enable.dictionary": "false"}).parquet(self.path)
        self.rows = replace(self.study, rows=spark.read.schema(_ROW).parquet(self.path), places=0)
        if before:
            remove(spark, before)

    def close(self) -> None:
        remove(self.study.rows.sparkSession, self.path)

    def sums(self, width: int, function, step: int) -> np.ndarray:
        """What ``function(rows, sums)`` adds up over all rows, ``step`` of them at a time."""
        parts, d = len(self.place), self.d

        def add(batch):
            out = np.zeros(width)
            for block in _blocks(batch, parts, d):
                for begin in range(0, len(block["_y"]), step):
                    function(_part(block, begin, begin + step), out)
            return out

        return _added(self.rows, self.needed, width, add, BLOCKS_AT_ONCE)

    def add_rounds(self, steps: Sequence[tuple[int, int, list]]) -> None:
        """Write the rows with the steps (place in _z, part, functions of bins and target) of the rounds since the last writing."""
        parts, d, where = len(self.place), self.d, self.place

        def run(batches):
            for batch in batches:
                for block in _blocks(batch, parts, d):
                    z = block["_z"].copy()
                    for begin in range(0, z.shape[1], FINE):
                        r = _part(block, begin, begin + FINE)
                        for place, part, rounds in steps:
                            for one in rounds:
                                z[place, begin : begin + FINE] += one(r["_b"][where[part]], r["_y"])
                    yield _record(block | {"_z": z, "_w": block["_w"] if (block["_w"] != 1).any() else []})

        self._write(self.rows.rows.mapInArrow(run, _ROW))


@dataclass
class _Step:
    """What a finished round adds to a row: a share of the tree's value, or the weight's logarithm where its vote is wrong."""

    tree: Grown
    size: float
    adaptive: bool

    def __call__(self, codes: np.ndarray, y: np.ndarray) -> np.ndarray:
        value = self.tree(codes)
        return self.size * ((value >= 0) != (y > 0.5)) if self.adaptive else self.size * value


def fit(study: Study, ensembles: Sequence[Ensemble], bins: int = BINS) -> Ensembles:
    """All ensembles on ``study.parts`` (of kind ``Held``), over all rows of each part; a part without both classes has no model."""
    ensembles, parts, d, m = list(ensembles), study.parts, len(study.columns), moments(study)
    unknown = {e.kind for e in ensembles} - {"forest", "extra", "boosted", "adaptive"}
    if unknown or not 2 <= bins <= 256:
        raise ValueError(f"unknown kinds {sorted(unknown)} or bins outside 2 to 256")
    fitted = [bool(m.classes[e.part].min() > 0) for e in ensembles]
    edges = {p: cut_points(study, parts[p], bins) for p in sorted({e.part for e, ok in zip(ensembles, fitted, strict=True) if ok})}
    out = Ensembles(ensembles, [[] for _ in ensembles], edges, [[] for _ in ensembles], fitted)
    live = [i for i, ok in enumerate(fitted) if ok]
    if not live:
        return out
    kinds = {ensembles[i].kind for i in live}
    sequential = any(ensembles[i].sequential for i in live)
    needed = [n for n in _NAMES if (n != "_h" or "forest" in kinds) and (n != "_z" or sequential)]
    table = _Table(study, edges, len(ensembles) if sequential else 0, needed)
    # weight of each class in each sample
    samples = [(i, t) for i in live for t in (range(ensembles[i].trees) if ensembles[i].kind == "forest" else [0])]

    def classes(r, total):
        own = total.reshape(-1, 2)
        for k, (i, t) in enumerate(samples):
            one = ensembles[i]
            w = r["_m"][where[one.part]] * r["_w"] * factor[one.part][r["_stratum"]]
            own[k] += np.bincount(r["_y"], _drawn(r["_h"], one, t) * w if one.kind == "forest" else w, 2)

    factor, where = m.factor, table.place
    mass = dict(zip(samples, table.sums(2 * len(samples), classes, FINE).reshape(-1, 2), strict=True))
    level = {i: 0.0 for i in live}  # logarithm of the adaptive weights' sum
    steps: dict[int, list[_Step]] = {i: [] for i in live}
    for i in live:
        level[i] = float(np.log(mass[i, 0].sum()))

    def balance(i: int, t: int) -> np.ndarray:
        own = mass[i, t if ensembles[i].kind == "forest" else 0]
        return np.where(own > 0, own.sum() / (2 * np.where(own > 0, own, 1)), 0)

    def count(growing: list[_Growing]) -> None:
        """Histograms of the wanted nodes of the first trees that a scan has room for."""
        jobs, at = [], 0
        for tree in growing:
            wide = tree.one.drawn(d) * bins * 3
            room = max(1 if not jobs else 0, (MOST_SUMS - at) // wide)
            if not room:
                break
            if not (nodes := tree.wanted[: int(room)]):
                continue
            known, place = tree.reached()
            slot = np.full(len(known.column), -1)
            slot[[place[v] for v in nodes]] = np.arange(len(nodes))
            columns = np.array([columns_of(v, tree.one, tree.number, d) for v in nodes])
            jobs.append((tree, nodes, columns, at, (tree.one, tree.fit, tree.number, known, slot, columns, at, balance(tree.fit, tree.number), level[tree.fit], list(steps[tree.fit]))))
            at += len(nodes) * wide
        plan = [j[-1] for j in jobs]
        most = max((len(nodes) for _, nodes, *_ in jobs), default=0) * bins

        def add(r, total):
            fixed: dict[int, np.ndarray] = {}
            fresh: dict[int, np.ndarray] = {}
            label, m = r["_y"], len(r["_y"])
            for one, i, number, known, slot, columns, start, weigh, logarithm, rounds in plan:
                wide, codes = columns.shape[1], r["_b"][where[one.part]]
                taking = r["_m"][where[one.part]].view(bool)
                if one.part not in fixed:
                    fixed[one.part] = r["_w"] * factor[one.part].take(r["_stratum"])
                if one.kind == "forest":
                    drawn = _drawn(r["_h"], one, number)
                    at = np.flatnonzero((drawn > 0) & taking)
                    own = slot.take(known.reached(codes, at))
                    if (own < 0).any():
                        on = np.flatnonzero(own >= 0)
                        own, at = own[on], at[on]
                else:
                    own = slot.take(known.reached(codes))
                    at = np.flatnonzero((own >= 0) & taking)
                    own = own.take(at)
                if not len(at):
                    continue
                y = label.take(at)
                w = fixed[one.part].take(at) * weigh.take(y)
                if one.sequential:
                    if i not in fresh:
                        fresh[i] = r["_z"][i] + sum((s(codes, label) for s in rounds), np.zeros(m))
                    z = fresh[i].take(at)
                    if one.kind == "boosted":
                        p = sigmoid(z)
                        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
                    else:
                        h = w * np.exp(z - logarithm)
                        g = h * (2.0 * y - 1)
                else:
                    if one.kind == "forest":
                        w *= drawn.take(at)
                    g, h = w * y, w
                size = len(columns) * wide * bins
                block = total[start : start + 3 * size].reshape(len(columns), wide, bins, 3)
                part, nodes, flat = own * bins, len(columns) * bins, codes.ravel()
                for j in range(wide):
                    code = part + (codes[j].take(at) if wide == d else flat.take(columns[:, j].take(own) * m + at))
                    for k, values in enumerate((g, h, None)):
                        block[:, j, :, k] += np.bincount(code, values, nodes).reshape(len(columns), bins)

        # histograms of many nodes are added up over more rows at once
        got = table.sums(at, add, max(FINE, 2 * most))
        out.scans += 1
        for tree, nodes, columns, start, _ in jobs:
            counts = got[start : start + len(nodes) * columns.shape[1] * bins * 3].reshape(len(nodes), columns.shape[1], bins, 3)
            for node, own, values in zip(nodes, columns, counts, strict=True):
                tree.absorb(node, own, values)
            tree.replay()

    side = [_Growing(ensembles[i], i, t, d) for i in live if not ensembles[i].sequential for t in range(ensembles[i].trees)]
    turn = [i for i in live if ensembles[i].sequential]
    rounds = {i: 0 for i in turn}
    ahead: list[_Growing] = []
    while side or turn:
        ahead = [g for g in ahead if g.wanted] + [_Growing(ensembles[i], i, rounds[i], d) for i in turn if not any(g.fit == i for g in ahead)]
        count(ahead + side)
        while side and not side[0].wanted:
            out.trees[side[0].fit].append(side.pop(0).grown())
        for tree in [g for g in ahead if not g.wanted]:
            ahead.remove(tree)
            i, one, grown = tree.fit, tree.one, tree.grown()
            rounds[i] += 1
            step, ended = _Step(grown, one.rate, False), rounds[i] >= one.trees
            if one.kind == "adaptive":
                leaves = np.array([s for v, s in tree.sums.items() if v not in tree.accepted and (v == 1 or v // 2 in tree.accepted)])
                error = float(np.maximum((leaves[:, 1] - np.abs(leaves[:, 0])) / 2, 0).sum() / leaves[:, 1].sum())
                if error >= 0.5 - 1e-12:
                    turn.remove(i)
                    continue
                vote = one.rate * np.log((1 - error) / max(error, 1e-12))
                out.votes[i].append(vote)
                step, ended = _Step(grown, vote, True), ended or error <= 1e-12
                level[i] += float(np.log(1 - error + error * np.exp(vote)))
            out.trees[i].append(grown)
            steps[i].append(step)
            if ended:
                turn.remove(i)
        if turn and max(max(len(steps[i]), sum((s.tree.column >= 0).sum() for s in steps[i]) * REFRESH / SPLITS) for i in turn) >= REFRESH:
            table.add_rounds([(i, ensembles[i].part, steps[i]) for i in turn])
            steps |= {i: [] for i in turn}
    table.close()
    return out


def predict(study: Study, fitted: Ensembles, tests: Sequence[tuple[int, int]]) -> DataFrame:
    """fit, the study's keys, target, probability of each (ensemble, part): the part's rows; ensembles without both classes give none."""
    tests = [(i, p) for i, p in tests if fitted.fitted[i]]
    parts, d, keys = [study.parts[p] for _, p in tests], len(study.columns), study.keys
    n, names = len(keys), ["fit", *keys, study.target, "probability"]
    schema = T.StructType([T.StructField("fit", T.IntegerType()), *[study.rows.schema[c] for c in keys], T.StructField(study.target, T.IntegerType()), T.StructField("probability", T.DoubleType())])

    def run(batches):
        for piece in _pieces(batches, max(16, batched.BLOCK // (4 * d))):
            r = _Rows(piece.select(batched._NEEDED), d, parts, None)
            for j, (i, _) in enumerate(tests):
                at = np.flatnonzero(r.members[:, j])
                if len(at):
                    score, rows = fitted.score(i, coded(r.x[at][:, :-1], fitted.edges[fitted.ensembles[i].part])), pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), *[piece.column(c).take(rows) for c in range(n + 1)], pa.array(score)], names=names)

    return study.rows.select(*keys, study.target, *batched._NEEDED).mapInArrow(run, schema)
