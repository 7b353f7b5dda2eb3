"""Distributed trees against numpy trees on the same bins, and against growth by one split at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import models
from lumenlake.operators import batched, folds, selection, trees

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 3))
    x[:, 2] = np.round(x[:, 2])  # ties
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1] - x[:, 2]))).astype(int)
    rows = [(i, f"p{i // 3}", int(y[i]), *map(float, x[i])) for i in range(500)]
    return rows, spark.createDataFrame(rows, "image long, patient string, target int, a double, b double, c double").repartition(4).cache()


@pytest.fixture(scope="module")
def study(cases):
    """Even images train, odd ones are scored."""
    one = batched.prepare(cases[1], ["image"], COLUMNS, "target", F.array((F.col("image") % 2).cast("int")))
    one.parts = [batched.Held(0, (0,)), batched.Held(0, (1,))]
    return one


@pytest.fixture(scope="module")
def local(study):
    """The same rows in numpy: hash, bins of the training part's cut points, target, and which train."""
    rows = study.rows.withColumn("h", F.xxhash64("image", "_x")).orderBy("image").collect()
    edges = trees.cut_points(study, study.parts[0])
    bins = trees.binned(np.array([r["_x"] for r in rows]), edges).astype(int)
    return np.array([r["h"] for r in rows]), bins, np.array([r["_y"] for r in rows]), np.array([r["_slots"][0] == 0 for r in rows])


def scored(study, one, local):
    made = trees.fit(study, [one])
    got = {r["image"]: r["probability"] for r in trees.predict(study, made, [(0, 1)]).collect()}
    held = np.flatnonzero(~local[3])
    assert sorted(got) == held.tolist()
    return made, np.array([got[i] for i in held])


def plain(model, local):
    """A numpy ensemble on given bins."""
    model._learn_bins = lambda x: None
    model._binned = lambda x: x
    _, bins, y, train = local
    return model.fit(bins[train], y[train]).score(bins[~train])


@pytest.mark.parametrize("depth, leaf", [(3, 5), (1, 1)])
def test_boosting_equals_numpy(study, local, depth, leaf, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH", 4)
    made, got = scored(study, trees.Ensemble(0, "boosted", 11, leaf=leaf, depth=depth, rate=0.3), local)
    assert got == pytest.approx(plain(models.Boosted(11, 0.3, depth, leaf), local), abs=1e-9)
    assert len(made.trees[0]) == 11 and made.scans <= 11 * depth


@pytest.mark.parametrize("depth", [1, 2])
def test_adaptive_equals_numpy(study, local, depth):
    made, got = scored(study, trees.Ensemble(0, "adaptive", 9, depth=depth, rate=0.5), local)
    assert got == pytest.approx(plain(models.Adaptive(9, 0.5, depth), local), abs=1e-9) and len(made.votes[0]) == 9


@pytest.mark.parametrize("room", [10**6, 3000])
def test_forest_equals_numpy_trees_on_the_same_samples(study, local, room, monkeypatch):
    """Also where a scan has room for few nodes of a tree only."""
    monkeypatch.setattr(trees, "MOST_SUMS", room)
    h, bins, y, train = local
    one = trees.Ensemble(0, "forest", 5 if room > 3000 else 2, leaf=3, depth=6)
    _, got = scored(study, one, local)
    expected = np.zeros((~train).sum())
    for t in range(one.trees):
        w = trees.times(h[train], one, t)
        mass = np.array([w[y[train] == v].sum() for v in (0, 1)])
        tree = models.Tree(6, 3).fit(bins[train], y[train], w * (w.sum() / (2 * mass))[y[train].astype(int)], trees.BINS)
        expected += tree.predict(bins[~train]) / one.trees
    assert got == pytest.approx(expected, abs=1e-9)


def test_samples_are_poisson(study):
    w = trees.times(np.arange(100_000), trees.Ensemble(0), 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert (w != trees.times(np.arange(100_000), trees.Ensemble(0), 4)).any()


def one_at_a_time(one, bins, g, h):
    """Leaves as row sets, the best split of all leaves each time: values of the rows' leaves and the cuts as a function."""
    def best(at):
        found = (0.0, None)
        if len(at) < 2 * one.leaf:
            return found
        own = g[at].sum() ** 2 / (h[at].sum() + one.ridge)
        for j in range(bins.shape[1]):
            for cut in range(trees.BINS):
                low = bins[at, j] <= cut
                if min(low.sum(), (~low).sum()) < one.leaf:
                    continue
                gain = sum(g[at[s]].sum() ** 2 / (h[at[s]].sum() + one.ridge) for s in (low, ~low)) - own
                if gain > found[0] * (1 + 1e-9) + 1e-12:
                    found = (gain, (j, cut))
        return found

    root = {"at": np.arange(len(g))}
    root["best"], leaves = best(root["at"]), [root]
    while len(leaves) < one.leaves:
        top = max(leaves, key=lambda v: v["best"][0])
        if top["best"][1] is None:
            break
        j, cut = top["best"][1]
        leaves = [v for v in leaves if v is not top]
        top["kids"] = []
        for side in (True, False):
            at = top["at"][(bins[top["at"], j] <= cut) == side]
            kid = {"at": at, "best": best(at)}
            top["kids"].append(kid)
            leaves.append(kid)

    def value(row):
        v = root
        while "kids" in v:
            j, cut = v["best"][1]
            v = v["kids"][0 if row[j] <= cut else 1]
        return g[v["at"]].sum() / (h[v["at"]].sum() + one.ridge)

    return lambda b: np.array([value(r) for r in b])


def test_best_leaf_first_with_penalty_equals_one_split_at_a_time(study, local):
    _, bins, y, train = local
    one = trees.Ensemble(0, "boosted", 3, leaf=4, depth=30, leaves=9, rate=0.4, ridge=2.0)
    made, got = scored(study, one, local)
    w, z, out = models.balanced(y[train]), np.zeros(train.sum()), np.zeros((~train).sum())
    for _ in range(3):
        p = models.sigmoid(z)
        tree = one_at_a_time(one, bins[train], w * (y[train] - p), w * np.maximum(p * (1 - p), 1e-6))
        z, out = z + 0.4 * tree(bins[train]), out + 0.4 * tree(bins[~train])
    assert got == pytest.approx(models.sigmoid(out), abs=1e-9)
    assert all((t.column < 0).sum() == 9 for t in made.trees[0]) and made.scans < 3 * 8


def test_random_cuts_and_drawn_columns(study, local):
    """Every split lies at the drawn cut of a drawn column, and is the best of these."""
    _, bins, y, train = local
    one = trees.Ensemble(0, "extra", 3, share="sqrt", leaf=2, depth=8)
    made, got = scored(study, one, local)
    w = models.balanced(y[train])
    for t, tree in enumerate(made.trees[0]):
        todo = [(0, 1, np.flatnonzero(train))]
        while todo:
            at, node, rows = todo.pop()
            own = w[np.searchsorted(np.flatnonzero(train), rows)]
            assert tree.value[at] == pytest.approx((own * y[rows]).sum() / own.sum(), abs=1e-9)
            if tree.column[at] < 0:
                continue
            columns = trees.columns_of(node, one, t, 3)
            assert len(columns) == 2
            cuts = trees.cuts_of(node, one, t, columns, bins[rows][:, columns].min(0), bins[rows][:, columns].max(0))
            gains = {}
            for j, cut in zip(columns, cuts):
                low = bins[rows, j] <= cut
                if min(low.sum(), (~low).sum()) >= 2:
                    gains[int(j), int(cut)] = sum((own[s] * y[rows[s]]).sum() ** 2 / own[s].sum() for s in (low, ~low))
            mine = (int(tree.column[at]), int(tree.cut[at]))
            assert gains[mine] == pytest.approx(max(gains.values()))
            low = bins[rows, mine[0]] <= mine[1]
            todo += [(tree.left[at], 2 * node, rows[low]), (tree.right[at], 2 * node + 1, rows[~low])]
    assert models.weighted_auc(y[~train], got) > 0.6


def test_all_kinds_and_folds_together(cases):
    rows, frame = cases
    slots = folds.repeated_folds(frame, "patient", "target", 3, 1, 5)
    made = {k: trees.Ensemble(0, k, 6, leaf=3, depth=4) for k in ("forest", "extra", "boosted", "adaptive")}
    got = selection.tree_scores(frame, slots, 3, ["image"], COLUMNS, "target", "patient", made).collect()
    assert len(got) == 4 * len(rows) and len({(r["configuration"], r["image"]) for r in got}) == len(got)
    for kind in made:
        own = [r for r in got if r["configuration"] == kind]
        assert models.weighted_auc(np.array([r["target"] for r in own]), np.array([r["probability"] for r in own])) > 0.65


def test_parts_of_one_class_and_constant_columns(spark):
    frame = spark.createDataFrame([(i, i % 2 if i < 20 else 1, 1.0, float(i)) for i in range(40)], "image long, target int, a double, b double")
    study = batched.prepare(frame, ["image"], ["a", "b"], "target", F.array((F.col("image") >= 20).cast("int")))
    study.parts = [batched.Held(0, (0,)), batched.Held(0, (1,)), batched.Held(0, (7,))]
    made = trees.fit(study, [trees.Ensemble(0, "forest", 2), trees.Ensemble(1, "forest", 2), trees.Ensemble(2, "boosted", 2)])
    assert made.fitted == [True, False, False]
    assert {r["fit"] for r in trees.predict(study, made, [(0, 1), (1, 0), (2, 0)]).collect()} == {0}
    with pytest.raises(ValueError):
        trees.fit(study, [trees.Ensemble(0, "other")])


def test_poisson_numbers_are_those_of_the_thresholds():
    one, rows = trees.Ensemble(0, "forest"), np.arange(200_000)
    h = trees.hashed(rows.astype(np.uint64), trees.OF_UNIT, one.seed + 7919 * 3).astype(np.float64)
    assert (trees.times(rows, one, 3) == np.searchsorted(trees._POISSON, h, "right")).all()


def test_rows_go_down_by_few_steps_whatever_the_tree():
    """A step moves every row a level: as often as the tree is deep, the same leaves as one row at a time; rows are packed bytes, not lists."""
    rng = np.random.default_rng(4)
    column, cut = np.array([1, -1, 0, 2, -1, -1, -1]), np.array([20, 0, 40, 9, 0, 0, 0])
    left, right = np.array([1, -1, 3, 5, -1, -1, -1]), np.array([2, -1, 4, 6, -1, -1, -1])
    tree = trees.Grown(column, cut, left, right, np.arange(7.0))
    bins = rng.integers(0, 64, (500, 3)).astype(np.uint8)

    def walk(row):
        node = 0
        while column[node] >= 0:
            node = left[node] if row[column[node]] <= cut[node] else right[node]
        return node

    assert tree.depth() == 3 and tree.leaf(bins).tolist() == [walk(r) for r in bins]
    packed = trees._packed(bins.astype(np.float64))
    assert (trees._unpacked(packed.slice(7, 90), np.float64) == bins[7:97]).all()
    assert trees._unpacked(packed.slice(0, 0), np.float64).shape[0] == 0


def test_scans_read_blocks_and_not_rows(study):
    """A task gets few records however many rows there are, whatever batch size a session was left with; columns of bytes go down a tree as single rows do."""
    spark = study.rows.sparkSession
    part = study.parts[0]
    table = trees._Table(study, {0: trees.cut_points(study, part)}, 1)
    try:
        records = table.rows.rows.count()
        assert records <= study.rows.rdd.getNumPartitions() < study.rows.count()
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        got = table.sums(2, lambda r, out: np.add.at(out, r["_y"][r["_m"][0] > 0], 1.0), 100)
        assert got.sum() == study.rows.where("_slots[0] = 0").count() and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    finally:
        table.close()
    rng = np.random.default_rng(2)
    column, cut = [-1], [0]
    left, right = [-1], [-1]
    for v in range(60):  # deep and wide: rows go down by levels; of the first splits, by columns
        column[v], cut[v], left[v], right[v] = int(rng.integers(3)), int(rng.integers(64)), len(column), len(column) + 1
        for x, value in ((column, -1), (cut, 0), (left, -1), (right, -1)):
            x += [value, value]
    codes = rng.integers(0, 64, (3, 700)).astype(np.uint8)
    for inner in (1, 5, 60):
        own = np.where(np.arange(121) < inner, column, -1)
        tree = trees.Grown(own, np.array(cut), np.array(left), np.array(right), np.arange(121.0))
        down = np.zeros(700, int)
        for i in range(700):
            while own[down[i]] >= 0:
                down[i] = left[down[i]] if codes[own[down[i]], i] <= cut[down[i]] else right[down[i]]
        assert (tree.reached(codes) == down).all() and (tree.reached(codes, np.arange(3, 90)) == down[3:90]).all()
