"""Small-table classifiers in numpy, for grids of fits that run one group a task.

Every model has ``fit(x, y, w)`` and ``score(x)``; scores rank, and are
probabilities where the model has them.  Large tables use ``operators.learn``.
"""

from __future__ import annotations

import numpy as np


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same total: n / (2 n_c)."""
    counts = np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    return (len(y) / (2.0 * counts))[y.astype(int)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Scaler:
    """Mean 0 and population deviation 1; a constant column is only centred."""

    def fit(self, x: np.ndarray) -> Scaler:
        self.mean = x.mean(0)
        deviation = x.std(0)
        self.deviation = np.where(deviation > 0, deviation, 1.0)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation


class Logistic:
    """Ridge logistic regression by Newton steps with backtracking.

    Minimises C * sum(w * loss) + |b|^2 / 2; the constant is a feature of its own
    and penalised with the rest if ``penalise_constant``.
    """

    def __init__(self, c: float = 1.0, class_weight: bool = True, penalise_constant: bool = True, steps: int = 100):
        self.c, self.class_weight, self.penalise_constant, self.steps = c, class_weight, penalise_constant, steps

    def fit(self, x, y, w=None):
        self.scale = Scaler().fit(x)
        x = np.column_stack([self.scale(x), np.ones(len(x))])
        w = np.ones(len(y)) if w is None else np.asarray(w, float)
        w = self.c * (w * balanced(y) if self.class_weight else w)
        ridge = np.ones(x.shape[1])
        ridge[-1] = 1.0 if self.penalise_constant else 1e-12
        b = np.zeros(x.shape[1])
        value = lambda b: (w * np.logaddexp(0, -(2 * y - 1) * (x @ b))).sum() + 0.5 * (ridge * b * b).sum()
        now = value(b)
        for _ in range(self.steps):
            p = sigmoid(x @ b)
            g = x.T @ (w * (p - y)) + ridge * b
            h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            d = np.linalg.solve(h, g)
            t = 1.0
            while t > 1e-10 and value(b - t * d) > now - 1e-4 * t * (g @ d):
                t /= 2
            b = b - t * d
            before, now = now, value(b)
            if before - now <= 1e-12 * (1 + abs(now)):
                break
        self.coef, self.constant = b[:-1], float(b[-1])
        return self

    def margin(self, x):
        return self.scale(x) @ self.coef + self.constant

    def score(self, x):
        return sigmoid(self.margin(x))


class Machine:
    """Support vector machine with hinge loss and class weights: dual coordinate ascent on a linear or Gaussian kernel.

    The constant is a feature of the kernel (value 1), so it is regularised.
    """

    def __init__(self, c: float = 1.0, gamma: float | str | None = None, epochs: int = 200):
        self.c, self.gamma, self.epochs = c, gamma, epochs

    def _kernel(self, a, b):
        if self.gamma is None:
            return a @ b.T + 1.0
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(-self.width * np.maximum(square, 0)) + 1.0

    def fit(self, x, y, w=None):
        self.scale = Scaler().fit(x)
        self.x = self.scale(x)
        self.width = 1.0 / (self.x.shape[1] * max(self.x.var(), 1e-12)) if self.gamma == "scale" else float(self.gamma or 0)
        sign = 2.0 * y - 1
        upper = self.c * balanced(y) * (1.0 if w is None else w)
        q = self._kernel(self.x, self.x) * sign[:, None] * sign[None, :]
        alpha = np.zeros(len(y))
        gradient = -np.ones(len(y))
        for _ in range(self.epochs * len(y)):
            move = np.clip(alpha - gradient / np.maximum(np.diag(q), 1e-12), 0, upper) - alpha
            i = int(np.argmax(np.abs(move) * np.diag(q)))
            if abs(move[i]) < 1e-6:
                break
            alpha[i] += move[i]
            gradient += q[:, i] * move[i]
        self.weights = alpha * sign
        return self

    def score(self, x):
        return self._kernel(self.scale(x), self.x) @ self.weights


class Tree:
    """Regression tree on binned columns: weighted least squares splits, depth- or leaf-limited."""

    def __init__(self, depth: int = 30, leaf: float = 1.0, columns: float = 1.0, random_cuts: bool = False, rng=None):
        self.depth, self.leaf, self.columns, self.random_cuts, self.rng = depth, leaf, columns, random_cuts, rng or np.random.default_rng(0)

    def fit(self, bins: np.ndarray, g: np.ndarray, w: np.ndarray, n_bins: int):
        self.nodes: list[tuple[int, int, int, int, float]] = []  # column, cut, left, right, value
        self._grow(bins, g, w, np.flatnonzero(w > 0), 0, n_bins)
        return self

    def _grow(self, bins, g, w, at, depth, n_bins) -> int:
        me = len(self.nodes)
        total, mass = (w[at] * g[at]).sum(), w[at].sum()
        self.nodes.append((-1, 0, -1, -1, total / mass if mass else 0.0))
        if depth >= self.depth or len(at) < 2 * self.leaf or len(at) < 2 or np.ptp(g[at]) < 1e-12:
            return me
        m = max(1, int(round(self.columns * bins.shape[1])))
        chosen = self.rng.choice(bins.shape[1], m, replace=False) if m < bins.shape[1] else np.arange(bins.shape[1])
        own = bins[at][:, chosen]
        code = (own + np.arange(m) * n_bins).ravel()
        sums = np.bincount(code, np.repeat(w[at] * g[at], m), m * n_bins).reshape(m, n_bins).cumsum(1)
        mass_at = np.bincount(code, np.repeat(w[at], m), m * n_bins).reshape(m, n_bins).cumsum(1)
        count = np.bincount(code, minlength=m * n_bins).reshape(m, n_bins).cumsum(1)
        ok = (count >= self.leaf) & (len(at) - count >= self.leaf) & (mass_at > 0) & (mass - mass_at > 0)
        if self.random_cuts:  # one random cut of each column
            low, high = own.min(0), own.max(0)
            pick = low + (self.rng.random(m) * np.maximum(high - low, 1)).astype(int)
            only = np.zeros_like(ok)
            only[np.arange(m), pick] = True
            ok &= only
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, sums**2 / mass_at + (total - sums) ** 2 / (mass - mass_at), -np.inf)
        best = int(gain.argmax())
        if not np.isfinite(gain.flat[best]) or gain.flat[best] <= total**2 / mass + 1e-12:
            return me
        column, cut = int(chosen[best // n_bins]), best % n_bins
        left = bins[at, column] <= cut
        a = self._grow(bins, g, w, at[left], depth + 1, n_bins)
        b = self._grow(bins, g, w, at[~left], depth + 1, n_bins)
        self.nodes[me] = (column, cut, a, b, self.nodes[me][4])
        return me

    def predict(self, bins: np.ndarray) -> np.ndarray:
        column, cut, left, right, value = (np.array(c) for c in zip(*self.nodes, strict=True))
        node = np.zeros(len(bins), int)
        while True:
            inner = np.flatnonzero(column[node] >= 0)
            if not len(inner):
                return value[node]
            k = node[inner]
            node[inner] = np.where(bins[inner, column[k]] <= cut[k], left[k], right[k])


class _Binned:
    bins = 64

    def _learn_bins(self, x):
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], shares)) for j in range(x.shape[1])]

    def _binned(self, x):
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])


class Forest(_Binned):
    """Bagged trees with balanced weights in each sample; ``random_cuts`` with whole samples are extremely randomised trees."""

    def __init__(self, trees: int = 500, leaf: float = 1, columns: float | str = "sqrt", depth: int = 30, random_cuts: bool = False, seed: int = 20260717):
        self.trees, self.leaf, self.columns, self.depth, self.random_cuts, self.seed = trees, leaf, columns, depth, random_cuts, seed

    def fit(self, x, y, w=None):
        self._learn_bins(x)
        bins, rng = self._binned(x), np.random.default_rng(self.seed)
        share = 1 / np.sqrt(x.shape[1]) if self.columns == "sqrt" else float(self.columns)
        base = np.ones(len(y)) if w is None else np.asarray(w, float)
        self.grown = []
        for _ in range(self.trees):
            drawn = base if self.random_cuts else base * np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
            mass = np.maximum([drawn[y == 0].sum(), drawn[y == 1].sum()], 1e-12)
            weight = drawn * (drawn.sum() / (2 * mass))[y.astype(int)]
            self.grown.append(Tree(self.depth, self.leaf, share, self.random_cuts, rng).fit(bins, y.astype(float), weight, self.bins))
        return self

    def score(self, x):
        bins = self._binned(x)
        return np.mean([t.predict(bins) for t in self.grown], axis=0)


class Boosted(_Binned):
    """Gradient boosting of the logistic loss with balanced weights."""

    def __init__(self, rounds: int = 300, rate: float = 0.05, depth: int = 3, leaf: float = 5, ridge: float = 0.0):
        self.rounds, self.rate, self.depth, self.leaf, self.ridge = rounds, rate, depth, leaf, ridge

    def fit(self, x, y, w=None):
        self._learn_bins(x)
        bins = self._binned(x)
        w = balanced(y) * (1.0 if w is None else w)
        p = (w * y).sum() / w.sum()
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        self.grown = []
        for _ in range(self.rounds):
            p = sigmoid(z)
            h = np.maximum(p * (1 - p), 1e-6)
            # a Newton leaf is the h-weighted mean of residual / h, shrunk by the ridge
            tree = Tree(self.depth, self.leaf).fit(bins, (y - p) / h, w * h, self.bins)
            step = self.rate * tree.predict(bins) * ((w * h).sum() / ((w * h).sum() + self.ridge))
            z = z + step
            self.grown.append(tree)
        return self

    def score(self, x):
        bins = self._binned(x)
        return sigmoid(self.base + self.rate * sum(t.predict(bins) for t in self.grown))


class Adaptive(_Binned):
    """AdaBoost (two-class SAMME) of shallow trees; the score is the weighted vote."""

    def __init__(self, rounds: int = 200, rate: float = 0.5, depth: int = 1):
        self.rounds, self.rate, self.depth = rounds, rate, depth

    def fit(self, x, y, w=None):
        self._learn_bins(x)
        bins = self._binned(x)
        sign = 2.0 * y - 1
        d = balanced(y) * (1.0 if w is None else w)
        d /= d.sum()
        self.grown = []
        for _ in range(self.rounds):
            tree = Tree(self.depth).fit(bins, sign, d, self.bins)
            vote = np.where(tree.predict(bins) >= 0, 1.0, -1.0)
            error = d[vote != sign].sum()
            if error >= 0.5:
                break
            a = self.rate * np.log((1 - error) / max(error, 1e-12))
            self.grown.append((a, tree))
            if error <= 1e-12:
                break
            d *= np.exp(a * (vote != sign))
            d /= d.sum()
        return self

    def score(self, x):
        bins = self._binned(x)
        total = sum(a for a, _ in self.grown) or 1.0
        return 0.5 + 0.5 * sum((a * np.where(t.predict(bins) >= 0, 1.0, -1.0) for a, t in self.grown), np.zeros(len(x))) / total


class Components:
    """Scaled, centred principal components divided by their deviations (ddof 1): k = min(wanted, n - 2, d), at least 2."""

    def __init__(self, k: int = 32):
        self.k = k

    def fit(self, x):
        k = min(self.k, len(x) - 2, x.shape[1])
        if k < 2:
            raise ValueError("too few rows or columns for components")
        self.scale = Scaler().fit(x)
        z = self.scale(x)
        self.centre = z.mean(0)
        _, s, v = np.linalg.svd(z - self.centre, full_matrices=False)
        v = v[:k]
        v *= np.sign(v[np.arange(k), np.abs(v).argmax(1)])[:, None]
        self.axes = v / (np.maximum(s[:k], 1e-12) / np.sqrt(len(x) - 1))[:, None]
        return self

    def __call__(self, x):
        return (self.scale(x) - self.centre) @ self.axes.T


class Embedded:
    """Logistic regression on whitened components of the columns from ``split`` on, beside the columns before it."""

    def __init__(self, c: float = 1.0, k: int = 32, split: int = 0):
        self.c, self.k, self.split = c, k, split

    def _join(self, x):
        return np.column_stack([x[:, : self.split], self.components(x[:, self.split :])])

    def fit(self, x, y, w=None):
        self.components = Components(self.k).fit(x[:, self.split :])
        self.model = Logistic(self.c).fit(self._join(x), y, w)
        return self

    def score(self, x):
        return self.model.score(self._join(x))


MODELS = {
    "logistic": Logistic,
    "linear_svm": Machine,
    "rbf_svm": lambda c=1.0, gamma="scale": Machine(c, gamma),
    "random_forest": Forest,
    "extra_trees": lambda **k: Forest(random_cuts=True, **k),
    "boosted": Boosted,
    "histogram_boosted": lambda **k: Boosted(**k),  # trees of bounded depth stand in for a bounded number of leaves
    "adaptive": Adaptive,
    "embedded": Embedded,
}

#: Parameter grids of a screen, by model (fixed values of the study protocol).
_C = (0.01, 0.1, 1.0, 10.0, 100.0)
GRIDS = {
    "logistic": [{"c": c} for c in _C],
    "linear_svm": [{"c": c} for c in _C],
    "rbf_svm": [{"c": c, "gamma": g} for c in (0.1, 1.0, 10.0, 100.0) for g in ("scale", 0.01, 0.1)],
    "random_forest": [{"columns": m, "leaf": leaf, "depth": d} for m in ("sqrt", 0.5) for leaf in (1, 3) for d in (30, 8)],
    "extra_trees": [{"columns": m, "leaf": leaf, "depth": d} for m in ("sqrt", 0.5) for leaf in (1, 3) for d in (30, 8)],
    "histogram_boosted": [{"rate": r, "depth": d, "ridge": x} for r in (0.03, 0.1) for d in (3, 4) for x in (0.0, 1.0, 10.0)],
    "boosted": [{"rate": r, "rounds": n, "depth": d} for r in (0.03, 0.1) for n in (100, 300) for d in (1, 2)],
    "adaptive": [{"rate": r, "rounds": n} for r in (0.03, 0.1, 0.5) for n in (100, 300)],
    "embedded": [{"c": c} for c in _C],
}


def make(name: str, params: dict):
    return MODELS[name](**params)


def weighted_auc(y: np.ndarray, score: np.ndarray, w: np.ndarray | None = None) -> float:
    """Weighted share of ordered (positive, negative) pairs, ties half; NaN for one class."""
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    _, at = np.unique(score, return_inverse=True)
    p, n = np.bincount(at, w * (y == 1)), np.bincount(at, w * (y == 0))
    if not p.sum() or not n.sum():
        return float("nan")
    return float((p * (n.cumsum() - n / 2)).sum() / (p.sum() * n.sum()))
