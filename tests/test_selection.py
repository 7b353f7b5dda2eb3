"""Batched fits against one numpy fit a cell, dealt folds, and permutations."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import models
from lumenlake.operators import batched, bootstrap, folds, selection

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Patients of one to four images, three datasets, a constant and a null among the columns."""
    rng = np.random.default_rng(11)
    rows, image = [], 0
    for p in range(150):
        y = int(rng.random() < 0.4)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((image, f"p{p}", "xyz"[p % 3], y if rng.random() < 0.9 else 1 - y, float(5 + 100 * (y + rng.normal())), float(rng.normal() - y / 3), float(rng.random() * 1e-3)))
            image += 1
    return pd.DataFrame(rows, columns=["image", "patient", "dataset", "target", *COLUMNS])


@pytest.fixture(scope="module")
def frame(spark, table):
    rows = [(int(r.image), r.patient, r.dataset, int(r.target), r.a, r.b, r.c) for r in table.itertuples()]
    return spark.createDataFrame([*rows, (9001, "p1", "x", 1, None, 1.0, 1.0), (9002, "p1", "x", None, 1.0, 1.0, 1.0)], "image long, patient string, dataset string, target int, a double, b double, c double").repartition(7).cache()


def numpy_scores(train, test, columns, c, weight=None):
    x, y = train[columns].to_numpy(), train["target"].to_numpy()
    if weight is None:
        fitted = models.Logistic(c).fit(x, y)
    else:
        fitted = models.Logistic(c, class_weight=False).fit(x, y, weight)
    return fitted.score(test[columns].to_numpy())


def stratum_weight(part, strata):
    sizes = part.groupby([*strata, "patient"])["image"].transform("count")
    groups = part.groupby(strata)["patient"].transform("nunique")
    return (len(part) / (part.groupby(strata).ngroups * groups * sizes)).to_numpy()


def slots_of(frame, inner=0, repeats=2, n=3):
    slots = folds.repeated_folds(frame.where("target IS NOT NULL"), "patient", "target", n, repeats, 5, inner).cache()
    return slots, {r["patient"]: r["slots"] for r in slots.collect()}


def test_out_of_fold_equals_a_fit_a_cell(frame, table):
    slots, own = slots_of(frame)
    subsets = {"all": COLUMNS, "two": ["c", "b"]}
    got = selection.out_of_fold(frame, slots, 2, 3, ["image"], COLUMNS, "target", "patient", [0.1, 10.0], subsets).toPandas()
    assert len(got) == len(table) * 2 * 2 * 2
    for r in range(2):
        fold = table["patient"].map(lambda p, r=r: own[p][r])
        for h in range(3):
            for s, cols in subsets.items():
                for c in (0.1, 10.0):
                    cell = got[(got.repeat == r) & (got.held == h) & (got.subset == s) & (got.c == c)].set_index("image")["probability"]
                    test = table[fold == h]
                    assert cell[test["image"]].to_numpy() == pytest.approx(numpy_scores(table[fold != h], test, cols, c), abs=1e-7)
    best = selection.tuned(selection.out_of_fold(frame, slots, 2, 3, ["image"], COLUMNS, "target", "patient", [0.1, 10.0]), "patient", "target").collect()
    w = 1 / table.groupby("patient")["image"].transform("count").to_numpy()
    for row in best:
        each = []
        for r in range(2):
            cell = got[(got.repeat == r) & (got.subset == "all") & (got.c == row["c"])].set_index("image")["probability"]
            each.append(models.weighted_auc(table["target"].to_numpy(), cell[table["image"]].to_numpy(), w))
        assert row["auc"] == pytest.approx(np.mean(each), abs=1e-9)
    assert [r["auc"] for r in best] == sorted((r["auc"] for r in best), reverse=True)


def test_weights_are_those_of_the_part(frame, table):
    """Strata and patients weigh alike inside every training part and every held part, as if nothing else existed."""
    slots, own = slots_of(frame)
    got = selection.out_of_fold(frame, slots, 2, 3, ["image"], COLUMNS, "target", "patient", [1.0, 100.0], strata=["dataset", "target"], equal_groups=True).cache()
    rows = got.toPandas()
    expected = {1.0: [], 100.0: []}
    for r in range(2):
        fold = table["patient"].map(lambda p, r=r: own[p][r])
        for h in range(3):
            train, test = table[fold != h], table[fold == h]
            for c in expected:
                cell = rows[(rows.repeat == r) & (rows.held == h) & (rows.c == c)].set_index("image")
                p = numpy_scores(train, test, COLUMNS, c, stratum_weight(train, ["dataset", "target"]))
                w = stratum_weight(test, ["dataset", "target"])
                assert cell["probability"][test["image"]].to_numpy() == pytest.approx(p, abs=1e-7)
                assert cell["weight"][test["image"]].to_numpy() == pytest.approx(w)
                expected[c].append(models.weighted_auc(test["target"].to_numpy(), p, w))
    tuned = {r["c"]: r for r in selection.tuned_by_part(got, "target").collect()}
    assert {c: r["auc"] for c, r in tuned.items()} == pytest.approx({c: np.mean(v) for c, v in expected.items()}, abs=1e-9)
    assert [c for c, r in tuned.items() if r["best"]] == [max(expected, key=lambda c: np.mean(expected[c]))]


def test_nested_equals_a_search_a_part(frame, table):
    slots, own = slots_of(frame, inner=2, repeats=1)
    cs = [0.01, 1.0]
    good = frame.where("target IS NOT NULL AND a IS NOT NULL")
    got = selection.nested(good, "patient", ["image"], COLUMNS, "target", 1, 3, 2, 5, cs).toPandas().set_index("image")
    again = folds.repeated_folds(good, "patient", "target", 3, 1, 5, 2)
    own = {r["patient"]: r["slots"] for r in again.collect()}
    assert len(got) == len(table) and got.index.is_unique
    fold = table["patient"].map(lambda p: own[p][0])
    for h in range(3):
        inside = table["patient"].map(lambda p, h=h: own[p][1 + h])
        assert ((inside == -1) == (fold == h)).all()
        train, test = table[fold != h], table[fold == h]
        value = {}
        for c in cs:
            each = []
            for i in range(2):
                a, b = table[(inside != i) & (inside >= 0)], table[inside == i]
                w = 1 / b.groupby("patient")["image"].transform("count").to_numpy()
                each.append(models.weighted_auc(b["target"].to_numpy(), numpy_scores(a, b, COLUMNS, c), w))
            value[c] = np.mean(each)
        best = max(cs, key=lambda c: (round(value[c], 12), -c))
        assert set(got.loc[test["image"], "c"]) == {best} and got.loc[test["image"], "inner_auc"].to_numpy() == pytest.approx(value[best], abs=1e-9)
        assert got.loc[test["image"], "probability"].to_numpy() == pytest.approx(numpy_scores(train, test, COLUMNS, best), abs=1e-7)


def test_transfer_and_ablation(frame, table):
    runs = {"x>": (["x"], ["y", "z"]), "others>x": (["y", "z"], ["x"]), "nobody>x": (["q"], ["x"])}
    subsets = {"full": COLUMNS, "less": ["a"]}
    scores, own = selection.by_dataset(frame, "dataset", ["image", "patient"], COLUMNS, "target", runs, 1.0, subsets)
    rows = scores.toPandas()
    assert list(own.valid()) == [True] * 4 + [False] * 2 and set(rows.run) == {"x>", "others>x"}
    for run, (train, test) in list(runs.items())[:2]:
        a, b = table[table.dataset.isin(train)], table[table.dataset.isin(test)]
        for s, cols in subsets.items():
            cell = rows[(rows.run == run) & (rows.subset == s)].set_index("image")["probability"]
            assert cell[b["image"]].to_numpy() == pytest.approx(numpy_scores(a, b, cols, 1.0), abs=1e-7) and len(cell) == len(b)
    out = {(r["run"], r["subset"]): r for r in selection.ablation(scores, "patient", "target", "full").collect()}
    assert len(out) == 4 and out["x>", "full"]["delta"] == 0
    assert out["x>", "less"]["delta"] == pytest.approx(out["x>", "full"]["auc"] - out["x>", "less"]["auc"])


def test_stability_equals_refits_on_repeated_rows(frame, table):
    good = frame.where("target IS NOT NULL AND a IS NOT NULL")
    rows, draws = bootstrap.drawn(good, "patient", 12, 9)
    study = batched.prepare(rows, ["image"], COLUMNS, "target", draws=draws)
    study.parts = [batched.Replicate(i) for i in range(12)]
    fitted = batched.fit(study, [batched.Fit(i, 1.0, (0, 1, 2)) for i in range(12)])
    m = {}
    for r in rows.select("patient", "_number", "_extra").distinct().collect():
        own = draws.poisson(np.array([r["_number"]]))[0].astype(int)
        np.add.at(own, r["_extra"], 1)
        m[r["patient"]] = own
    for i in range(12):
        again = table.loc[table.index.repeat([m[p][i] for p in table["patient"]])]
        model = models.Logistic(1.0).fit(again[COLUMNS].to_numpy(), again["target"].to_numpy())
        assert fitted.coefficients[i] == pytest.approx(model.coef, abs=1e-6) and fitted.constants[i] == pytest.approx(model.constant, abs=1e-6)
    out = {r["column"]: r for r in selection.stability(good, "patient", COLUMNS, "target", 12, 9).collect()}
    assert out["a"]["median"] == pytest.approx(np.median([c[0] for c in fitted.coefficients])) and out["a"]["sign_consistency"] == 1


def test_many_tasks_add_up_in_a_tree(spark, frame, monkeypatch):
    monkeypatch.setattr(batched, "DIRECT_BYTES", 0)
    monkeypatch.setattr(batched, "FAN", 3)
    monkeypatch.setattr(batched, "BLOCK", 40)
    study = batched.prepare(frame, ["image"], COLUMNS, "target", F.array(F.lit(0)))
    study.parts = [batched.Held(0, (0,))]
    tree = batched.fit(study, [batched.Fit(0, 1.0, (0, 1, 2))])
    monkeypatch.undo()
    direct = batched.fit(study, [batched.Fit(0, 1.0, (0, 1, 2))])
    assert study.places > 3 and tree.flat[0] == pytest.approx(direct.flat[0], abs=1e-9) and tree.scans < 15


def test_parts_of_one_class_and_constant_columns(spark):
    rows = [(i, f"p{i}", 0, float(i), 7.0) for i in range(6)]
    one = spark.createDataFrame(rows, "image long, patient string, target int, a double, k double")
    study = batched.prepare(one, ["image"], ["a", "k"], "target", F.array(F.lit(0)))
    study.parts = [batched.Held(0, (0,)), batched.Held(0, (5,))]
    fits = [batched.Fit(0, 1.0, (0, 1)), batched.Fit(1, 1.0, (0,))]
    fitted = batched.fit(study, fits)
    assert not fitted.valid().any() and batched.predict(study, fitted, [(0, 0), (1, 0)]).count() == 0
    both = spark.createDataFrame([(i, f"p{i}", i % 2, float(i), 7.0) for i in range(10)], one.schema)
    study = batched.prepare(both, ["image"], ["a", "k"], "target", F.array(F.lit(0)))
    study.parts = [batched.Held(0, (0,))]
    fitted = batched.fit(study, [batched.Fit(0, 1.0, (0, 1))])
    model = models.Logistic(1.0).fit(np.array([[i, 7.0] for i in range(10)]), np.array([i % 2 for i in range(10)]))
    assert fitted.coefficients[0] == pytest.approx(model.coef, abs=1e-8)
    assert batched.fit(study, []).flat.shape[0] == 0


# ------------------------------------------------------------------ folds


def test_signatures_are_dealt_evenly(spark):
    """A million interchangeable groups are one signature: the driver sees signatures, and no fold has more than its share and one."""
    counts = spark.range(20_000).select(F.col("id").alias("g"), F.when(F.col("id") % 3 == 0, 2).otherwise(1).cast("long").alias("negatives"), (F.col("id") % 2).cast("long").alias("positives"))
    out = folds.dealt(counts, [], "g", 7, 3)
    sizes = out.join(counts, "g").groupBy("negatives", "positives", "fold").count().collect()
    by = {}
    for r in sizes:
        by.setdefault((r["negatives"], r["positives"]), []).append(r["count"])
    assert out.count() == 20_000 and all(len(v) == 7 and max(v) - min(v) <= 1 for v in by.values())
    again = {r["g"]: r["fold"] for r in folds.dealt(counts.repartition(9), [], "g", 7, 3).collect()}
    assert again == {r["g"]: r["fold"] for r in out.collect()}


def test_rest_goes_where_classes_are_most_even():
    counts = np.array([[3.0, 0.0], [0.0, 3.0], [1.0, 1.0]])
    share, rest = folds.deal_signatures(counts, np.array([9, 10, 5]), 4, 1)
    assert share.tolist() == [2, 2, 1] and [len(r) for r in rest] == [1, 2, 1] and all(len(set(r)) == len(r) for r in rest)
    assert rest[0][0] not in rest[1] or len(set(rest[0] + rest[1])) >= 2


def test_repeated_folds(frame):
    slots, own = slots_of(frame, inner=2, repeats=2)
    values = np.array(list(own.values()))
    assert values.shape[1] == 2 + 2 * 3 and values[:, :2].min() == 0 and values[:, :2].max() == 2
    assert (values[:, 0] != values[:, 1]).any()
    for r in range(2):
        for h in range(3):
            inner = values[:, 2 + 3 * r + h]
            assert ((inner == -1) == (values[:, r] == h)).all() and set(inner) == {-1, 0, 1}


# ------------------------------------------------------------------ permutations


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 65, 5000])
def test_bijection(size):
    to = selection.bijection(np.arange(size), size, 77)
    assert sorted(to.tolist()) == list(range(size))
    if size > 1000:
        other = selection.bijection(np.arange(size), size, 178)
        assert (to != other).mean() > 0.99 and (to == np.arange(size)).sum() < 10
        assert abs(np.corrcoef(to, np.arange(size))[0, 1]) < 0.05 and abs(np.corrcoef(to[1:], to[:-1])[0, 1]) < 0.05


def test_permutation_importance_equals_numpy(frame, table):
    good = frame.where("target IS NOT NULL AND a IS NOT NULL")
    families = {"first": ["a"], "rest": ["b", "c"]}
    got = {(r["family"], r["permutation"]): r["drop"] for r in selection.permutation_importance(good, "image", COLUMNS, families, "target", "patient", 1.0, 4, 3).collect()}
    assert len(got) == 8
    order = sorted(table["image"], key=str)
    rows = table.set_index("image").loc[order]
    y, w = rows["target"].to_numpy(), (1 / rows.groupby("patient")["target"].transform("count")).to_numpy()
    model = models.Logistic(1.0).fit(rows[COLUMNS].to_numpy(), y)
    base = models.weighted_auc(y, model.score(rows[COLUMNS].to_numpy()), w)
    for j, (family, cols) in enumerate(families.items()):
        for p in range(4):
            to = selection.bijection(np.arange(len(rows)), len(rows), 3 + 1_000_003 * j + 101 * p)
            x = rows[COLUMNS].to_numpy().copy()
            at = [COLUMNS.index(c) for c in cols]
            moved = np.empty_like(x[:, at])
            moved[to] = x[:, at]
            x[:, at] = moved
            assert got[family, p] == pytest.approx(base - models.weighted_auc(y, np.round(model.margin(x), 11), w), abs=2e-3)
    assert np.mean([got["first", p] for p in range(4)]) > np.mean([got["rest", p] for p in range(4)])


def test_nothing_runs_a_whole_table_in_one_task(spark, sf_dir):
    from lumenlake.plans import catalog

    for name in ("weighted_tuning", "transfer_pairs"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("FlatMapGroupsInPandas|CartesianProduct", plan), name


@pytest.mark.parametrize("room", [40, 1_000_000])
def test_aucs_of_arrays_are_those_of_the_scores(frame, room, monkeypatch):
    """Tuning hands on sorted arrays in stretches: no row a score, the same figures."""
    monkeypatch.setattr(batched, "ROWS_IN_STRETCH", room)
    slots, _ = slots_of(frame)
    two = {"all": COLUMNS, "two": ["c", "b"]}
    want = selection.tuned(selection.out_of_fold(frame, slots, 2, 3, ["image"], COLUMNS, "target", "patient", [0.1, 10.0], two), "patient", "target").toPandas()
    tuned = selection.tuned_folds(frame, slots, 2, 3, COLUMNS, "target", "patient", [0.1, 10.0], two)
    got = tuned.toPandas()
    assert got[["subset", "c"]].equals(want[["subset", "c"]]) and got["auc"].to_numpy() == pytest.approx(want["auc"].to_numpy(), abs=1e-12)
    assert "MapInArrow" in tuned._jdf.queryExecution().executedPlan().toString()
    scores = selection.out_of_fold(frame, slots, 2, 3, ["image"], COLUMNS, "target", "patient", [0.1, 10.0], strata=["dataset", "target"], equal_groups=True)
    want = selection.tuned_by_part(scores, "target").toPandas().sort_values("c").reset_index(drop=True)
    got = selection.tuned_parts(frame, slots, 2, 3, COLUMNS, "target", "patient", ["dataset", "target"], [0.1, 10.0]).toPandas().sort_values("c").reset_index(drop=True)
    assert got[["subset", "c", "best"]].equals(want[["subset", "c", "best"]]) and got["auc"].to_numpy() == pytest.approx(want["auc"].to_numpy(), abs=1e-12)


def test_ablation_of_arrays_is_that_of_the_scores(frame, monkeypatch):
    monkeypatch.setattr(batched, "ROWS_IN_STRETCH", 60)
    runs, subsets = {"to_z": (["x", "y"], ["z"]), "to_x": (["y"], ["x"])}, {"full": COLUMNS, "two": COLUMNS[:2]}
    scores, _ = selection.by_dataset(frame, "dataset", ["image", "patient"], COLUMNS, "target", runs, subsets=subsets, strata=["dataset", "target"], group="patient")
    want = selection.ablation(scores, "patient", "target", "full").toPandas().sort_values(["run", "subset"])
    got = selection.ablated(frame, "dataset", COLUMNS, "target", "patient", runs, subsets, "full", strata=["dataset", "target"], equal_groups=True).toPandas().sort_values(["run", "subset"])
    assert len(got) == 4 and got[["run", "subset"]].to_numpy().tolist() == want[["run", "subset"]].to_numpy().tolist()
    assert got[["auc", "delta"]].to_numpy() == pytest.approx(want[["auc", "delta"]].to_numpy(), abs=1e-12)


def test_embedded_screen_equals_a_fit_a_cell_and_gathers_no_cell(spark, sf_dir):
    from lumenlake.operators import learn
    from lumenlake.plans import learn_queries as q

    got = q.screen_embedded(spark, sf_dir)
    assert not re.search("FlatMapGroupsInPandas|CartesianProduct", got._jdf.queryExecution().executedPlan().toString())
    rows = q.study(spark, sf_dir)
    want = learn.grid_scores(rows, q.outer_folds(rows, 1, 4), ["image", "patient_id", "dataset"], q.COLUMNS, "target", "patient_id", "embedded", [{"c": 1.0, "k": 4}])
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    a, b = (x.toPandas().sort_values("image").reset_index(drop=True) for x in (got, want))
    own = [c for c in a if c != "probability"]
    assert len(a) and a[own].equals(b[own])
    assert a["probability"].to_numpy() == pytest.approx(b["probability"].to_numpy(), abs=1e-7)


# ------------------------------------------------------------------ components and fusion


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(21)
    turn = rng.normal(size=(9, 9))
    rows = []
    for i in range(260):
        y = int(rng.random() < 0.5)
        rows.append((i, f"p{i // 3}", "xy"[i % 2], y, float(y + rng.normal()), *map(float, (rng.normal(size=9) + 0.8 * y * np.eye(9)[0]) @ turn)))
    names = ["image", "patient", "dataset", "target", "h", *[f"e{j}" for j in range(9)]]
    data = pd.DataFrame(rows, columns=names)
    frame = spark.createDataFrame(rows, "image long, patient string, dataset string, target int, h double, " + ", ".join(f"e{j} double" for j in range(9)))
    return data, frame.repartition(5).cache()


def test_components_are_those_of_the_training_part(pictures):
    data, frame = pictures
    entries = [f"e{j}" for j in range(9)]
    slots = folds.repeated_folds(frame, "patient", "target", 3, 2, 5).cache()
    own = {r["patient"]: r["slots"] for r in slots.collect()}
    designs = {"embedding": selection.Design(embedded=entries, k=4), "fusion": selection.Design(["h"], entries, 4), "hand": ["h"]}
    scores = selection.out_of_fold(frame, slots, 2, 3, ["image"], ["h", *entries], "target", "patient", [0.5], designs).cache()
    got = scores.toPandas()
    for r in range(2):
        fold = data["patient"].map(lambda p, r=r: own[p][r])
        for h in range(3):
            train, test = data[fold != h], data[fold == h]
            y = train["target"].to_numpy()
            embedded = models.Embedded(0.5, 4).fit(train[entries].to_numpy(), y).score(test[entries].to_numpy())
            both = models.Embedded(0.5, 4, 1).fit(train[["h", *entries]].to_numpy(), y).score(test[["h", *entries]].to_numpy())
            cell = got[(got.repeat == r) & (got.held == h)].set_index(["subset", "image"])["probability"]
            assert cell.loc["embedding"][test["image"]].to_numpy() == pytest.approx(embedded, abs=1e-7)
            assert cell.loc["fusion"][test["image"]].to_numpy() == pytest.approx(both, abs=1e-7)
    fused = selection.fused(scores, 2, 3, "patient", ["image"], "target", ["hand", "embedding"]).toPandas()
    wide = got[got.subset != "fusion"].pivot(index=["repeat", "held", "image", "target"], columns="subset", values="probability").reset_index()
    assert len(fused) == 2 * len(data)
    for r in range(2):
        for h in range(3):
            train, test = wide[(wide.repeat == r) & (wide.held != h)], wide[(wide.repeat == r) & (wide.held == h)]
            model = models.Logistic(1.0).fit(train[["hand", "embedding"]].to_numpy(), train["target"].to_numpy())
            cell = fused[(fused.repeat == r) & (fused.held == h)].set_index("image")
            assert cell["stacked"][test["image"]].to_numpy() == pytest.approx(model.score(test[["hand", "embedding"]].to_numpy()), abs=1e-7)
            assert cell["mean"][test["image"]].to_numpy() == pytest.approx(test[["hand", "embedding"]].mean(axis=1).to_numpy())
    with pytest.raises(ValueError, match="components"):
        selection.out_of_fold(frame, slots, 1, 3, ["image"], ["h", *entries], "target", "patient", [0.5], {"one": selection.Design(embedded=["e1"])})


def test_transfer_of_fused_designs(pictures):
    data, frame = pictures
    entries = [f"e{j}" for j in range(9)]
    scores, _ = selection.by_dataset(frame, "dataset", ["image", "patient"], ["h", *entries], "target", {"x>y": (["x"], ["y"])}, 1.0, {"fusion": selection.Design(["h"], entries, 5)})
    got = scores.toPandas().set_index("image")["probability"]
    train, test = data[data.dataset == "x"], data[data.dataset == "y"]
    model = models.Embedded(1.0, 5, 1).fit(train[["h", *entries]].to_numpy(), train["target"].to_numpy())
    assert got[test["image"]].to_numpy() == pytest.approx(model.score(test[["h", *entries]].to_numpy()), abs=1e-7)


def test_permutations_of_a_bounded_table_move_no_row(frame, monkeypatch):
    """They are ranked where the shares are, and as those of a larger table, which moves them."""
    good = frame.where("target IS NOT NULL AND a IS NOT NULL")
    ask = lambda: selection.permutation_importance(good, "image", COLUMNS, {"first": ["a"], "rest": ["b", "c"]}, "target", "patient", 1.0, 3, 5)
    near = ask()
    assert not re.search("Exchange hashpartitioning|SortMergeJoin", near._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(selection, "PERMUTED_AT_ONCE", 0)
    far = {(r["family"], r["permutation"]): r["drop"] for r in ask().collect()}
    got = {(r["family"], r["permutation"]): r["drop"] for r in near.collect()}
    assert len(got) == 6 and got == pytest.approx(far, abs=1e-12)
    key = np.full(5000, 77)
    assert (selection.bijection(np.arange(5000), 5000, 77) == selection.bijection(np.arange(5000), 5000, key)).all()


def test_logistic_fit_joins_its_table_once(spark, sf_dir):
    """Newton steps and the scores read the written rows; none joins the tables again."""
    from lumenlake.plans import catalog

    out = catalog.QUERIES["logistic_fit"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin|Exchange hashpartitioning", plan)
    assert out.where("probability IS NULL OR probability < 0 OR probability > 1").isEmpty()


def test_newton_takes_a_last_small_step_without_an_evaluation():
    """Of a function that bends alike everywhere, the step to the minimum is the last evaluation."""
    turn = np.array([[3.0, 1.0], [1.0, 2.0]])
    value = lambda x: (0.5 * (x - 1) @ turn @ (x - 1), turn @ (x - 1), turn)
    found, taken = batched.newton([np.zeros(2)], np.array([0]), lambda active, trials: [value(x) for x in trials], 60, True)
    assert taken == 2 and np.allclose(found[0], 1, atol=1e-12)


def test_scan_shares_margins_of_equal_coefficients(monkeypatch):
    """A scan of fits at one point equals that of each alone, and the losses their formulas."""
    rng = np.random.default_rng(8)
    z, y = np.concatenate([rng.normal(0, 3, (50, 2)), [[-800.0, 800.0]]]), rng.integers(0, 2, 51).astype(float)
    loss, slope, bend = batched.losses(z, y, np.zeros(2, bool))
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    assert np.allclose(loss, np.logaddexp(0, -(2 * y - 1)[:, None] * z), atol=1e-14) and np.allclose(slope, p - y[:, None], atol=1e-14) and np.allclose(bend, p * (1 - p), atol=1e-14)
    n, d = 500, 3
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.array(x.ravel()).type))
    block = pa.RecordBatch.from_arrays([lists(rng.normal(size=(n, d))), pa.array(rng.integers(0, 2, n).astype(float)), pa.array(rng.random(n)), pa.array(rng.integers(0, 2, n).astype(np.int32)), lists(rng.integers(0, 3, (n, 1)).astype(np.int32))], names=batched._NEEDED)
    monkeypatch.setattr(batched, "_added", lambda study, columns, width, add: add(block))
    study = batched.Study(None, [], list("abc"), "target", 2, parts=[batched.Held(0, (0, 1)), batched.Held(0, (1, 2))])
    m = batched.moments(study)
    at = np.tile(rng.normal(size=d + 1), (2, 1))
    for kind in ("logistic", "hinge"):
        fits = [batched.Fit(p, 1.0, (0, 1, 2), loss=kind) for p in (0, 1)]
        alone = np.concatenate([batched._scan(study, m, [f], at[:1], 0.3) for f in fits])
        assert np.allclose(batched._scan(study, m, fits, at, 0.3), alone, rtol=1e-12)
        monkeypatch.setattr(batched, "IN_CACHE", 1000)


@pytest.mark.parametrize("kind", ["plain", "equal", "near", "many weights"])
def test_ranks_by_sorted_keys_are_exact(kind, monkeypatch):
    """As scores ranked one by one, also where scores are equal or agree but for the bits that carry target and weight."""
    rng = np.random.default_rng(6)
    score = rng.normal(size=5000)
    if kind == "equal":
        score = np.round(score, 1)
    if kind == "near":
        score = np.round(score, 1) * (1 + rng.integers(-6, 6, 5000) * 2.3e-16)
    if kind == "many weights":
        monkeypatch.setattr(selection._Ranks, "MOST", 4)
    monkeypatch.setattr(selection, "SENT_AT_ONCE", 700)
    y, w = (rng.random(5000) < 0.4).astype(np.int8), 1 / rng.integers(1, 30, 5000)
    got = selection._Ranks(y, w).auc(score.copy(), np.empty(5000, np.int64))
    assert got == pytest.approx(models.weighted_auc(y, score, w), abs=1e-12)
    assert selection._Ranks(np.zeros(9, np.int8), np.ones(9)).auc(np.arange(9.0), np.empty(9, np.int64)) is None


def test_permutations_of_nine_million_rows_move_none():
    """The driver's 1 GB: no share is joined or shuffled for a permutation."""
    assert selection.PERMUTED_AT_ONCE >= 9_000_000


def test_nested_search_scores_with_chosen_models_alone(frame, monkeypatch):
    """Held rows are scored by the model of the best C, not by all of them and a join; a score goes through the shuffle with a byte or two of weight."""
    good = frame.where("target IS NOT NULL AND a IS NOT NULL")
    asked, predict = [], selection.predict
    monkeypatch.setattr(selection, "predict", lambda study, fitted, tests: asked.append(len(tests)) or predict(study, fitted, tests))
    out = selection.nested(good, "patient", ["image"], COLUMNS, "target", 2, 3, 2, 5, (0.01, 1.0, 100.0))
    assert asked == [6] and out.groupBy("image", "repeat").count().where("count > 1").isEmpty()
    w = 1 / np.random.default_rng(1).integers(1, 200, 999)
    w[::3] = 0
    packed = batched.packed_weights(w)
    assert len(packed) < 1000 and (batched.unpacked_weights(packed, 999) == w).all()
    odd = w * 0.3
    assert (batched.unpacked_weights(batched.packed_weights(odd), 999) == odd).all()
    assert batched.unpacked_weights(batched.packed_weights(np.zeros(5)), 5).tolist() == [0.0] * 5 and (batched.unpacked_weights(batched.packed_weights(np.ones(1)), 1) == 1).all()
