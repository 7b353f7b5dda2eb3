"""Landmark maps and hinge machines against the exact dual of the kernel machine."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import models
from lumenlake.operators import batched, folds, kernels, selection


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes that no line parts."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        y = i % 2
        angle, radius = rng.random() * 6.28, 1 + 1.2 * y + rng.normal() * 0.35
        rows.append((i, f"p{i // 2 % 80}", y, float(3 + 10 * radius * np.cos(angle)), float(radius * np.sin(angle))))
    frame = spark.createDataFrame(rows, "image long, patient string, target int, a double, b double").repartition(4).cache()
    return rows, frame


def whole(frame):
    study = batched.prepare(frame, ["image"], ["a", "b"], "target", F.array(F.lit(0)))
    study.parts = [batched.Held(0, (0,)), batched.Held(0, (1,))]
    return study


def test_smoothed_hinge():
    z, y = np.linspace(-2, 2, 401)[:, None], np.ones(401)
    loss, slope, bend = batched.losses(z, y, np.ones(1, bool))
    assert np.abs(loss[:, 0] - np.maximum(0, 1 - z[:, 0])).max() <= batched.SMOOTH[-1] / 2 + 1e-12
    assert np.abs(np.gradient(loss[:, 0], z[:, 0])[5:-5] - slope[5:-5, 0]).max() < 0.51 and set(np.unique(bend)) <= {0, 1 / batched.SMOOTH[-1]}
    both = batched.losses(np.column_stack([z, z]), y, np.array([True, False]))
    assert both[0][:, 0] == pytest.approx(loss[:, 0]) and both[0][:, 1] == pytest.approx(np.logaddexp(0, -z[:, 0]))


def test_all_rows_as_landmarks_give_the_exact_kernel(rings):
    rows, _ = rings
    x = np.array([r[3:] for r in rows])
    own = kernels.landmark_map(x, x.mean(0), x.std(0), "scale")
    features = own(x)
    exact = own.kernel((x - x.mean(0)) / x.std(0)) + 1
    assert np.abs(features @ features.T - exact).max() < 1e-6
    few = kernels.landmark_map(x[:60], x.mean(0), x.std(0), "scale")(x)
    assert np.abs(few @ few.T - exact).mean() < 0.02 and np.abs(few @ few.T - exact).max() < 0.2


def test_machine_equals_the_exact_dual(rings):
    landmarks, error = 60, 0.03
    rows, frame = rings
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    study = whole(frame)
    fitted = kernels.fit(study, [kernels.Machine(0, 1.0), kernels.Machine(1, 1.0)], landmarks)
    got = {r["image"]: r["probability"] for r in kernels.predict(study, fitted, [(0, 0), (1, 0)]).collect()}
    dual = models.Machine(1.0, "scale", epochs=400).fit(x, y).score(x)
    z = np.array([got[r[0]] for r in rows])
    assert len(got) == 240 and fitted.maps[1] is None
    assert np.abs(z - dual).mean() < error * np.abs(dual).mean() + 0.01
    assert models.weighted_auc(y, z) > 0.9


def test_linear_machine_equals_the_exact_dual(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 2)) * [1, 20]
    y = (x[:, 0] + x[:, 1] / 20 + rng.normal(size=150) * 0.7 > 0).astype(int)
    frame = spark.createDataFrame([(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x, strict=True))], "image long, target int, a double, b double")
    study = whole(frame)
    fitted = batched.fit(study, [batched.Fit(0, 0.1, (0, 1), loss="hinge")])
    dual = models.Machine(0.1, None, epochs=400).fit(x, y).score(x)
    got = {r["image"]: r["probability"] for r in batched.predict(study, fitted, [(0, 0)]).collect()}
    assert np.abs(np.array([got[i] for i in range(150)]) - dual).max() < 0.03


def test_out_of_fold_machines(rings):
    rows, frame = rings
    slots = folds.repeated_folds(frame, "patient", "target", 3, 1, 7).cache()
    scores = selection.machine_scores(frame, slots, 3, ["image"], ["a", "b"], "target", "patient", (2.0,), ("scale", None)).toPandas()
    assert len(scores) == 2 * len(rows) and set(scores.gamma) == {"scale", "linear"}
    own = {r["patient"]: r["slots"][0] for r in slots.collect()}
    assert all(own[p] == h for p, h in zip(scores.patient, scores.held, strict=True))
    auc = {g: models.weighted_auc(s.target.to_numpy(), s.probability.to_numpy()) for g, s in scores[scores.c == 2.0].groupby("gamma")}
    assert auc["scale"] > 0.85 > auc["linear"]


def test_kernel_is_turned_by_the_driver_alone():
    """Sums over untouched kernel columns, turned once, are those over the rows' features."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    one = kernels.landmark_map(x[:15], x.mean(0), x.std(0), "scale")
    raw = np.column_stack([one.raw(x), np.ones(len(x))])
    assert one.size == 16 and one(x) == pytest.approx(raw @ one.turns(), abs=1e-12)
    assert one(x).T @ one(x) == pytest.approx(one.turns().T @ (raw.T @ raw) @ one.turns(), abs=1e-8)


def test_similarity_takes_pictures_in_small_batches(spark, sf_dir):
    """Ten thousand pairs of 64 x 64 pictures, Spark's own batch, are 655 MB of a worker."""
    from lumenlake.operators import extract
    from lumenlake.plans import catalog

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    out = catalog.QUERIES["kernel_similarity"](spark, sf_dir)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(extract.BATCH_ROWS) and out.count() > 0


def test_machines_of_a_large_table_start_near_their_minimum(spark, monkeypatch):
    """Starts on few rows and on ten times as many: the minimum over all rows is the same, and few scans of all rows are left."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 2))
    y = (x[:, 0] * x[:, 1] + 0.5 * rng.normal(size=6000) > 0).astype(int)
    frame = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(6000)], "image long, target int, a double, b double")
    study = batched.prepare(frame, ["image"], ["a", "b"], "target", F.array((F.col("image") % 3 > 0).cast("int")))
    study.parts = [batched.Held(0, (0,)), batched.Held(0, (1,))]
    sizes, added = [], batched._added

    def counted(rows, *rest):
        sizes.append(rows is study)
        return added(rows, *rest)

    monkeypatch.setattr(batched, "_added", counted)
    monkeypatch.setattr(kernels, "_added", counted)
    fits = [batched.Fit(0, 0.5, (0, 1), loss="hinge"), batched.Fit(1, 5.0, (0, 1), loss="hinge")]

    def run():
        sizes.clear()
        plain, machines = batched.fit(study, fits), kernels.fit(study, [kernels.Machine(0, 1.0), kernels.Machine(1, 1.0)], 30)
        return plain.flat, np.concatenate(machines.weights), sum(sizes)

    flat, weights, scans = run()
    monkeypatch.setattr(batched, "START_ROWS", 90)
    near, same, fewer = run()
    assert near == pytest.approx(flat, abs=1e-5) and same == pytest.approx(weights, abs=1e-4) and max(fewer, scans) < 120
    assert len(sizes) > fewer


def test_similarity_takes_every_picture_that_has_a_next_one(spark, sf_dir):
    """Odd pictures too."""
    from lumenlake.plans import catalog
    from lumenlake.plans.registry import read

    images = {r[0] for r in read(spark, sf_dir, "embeddings").select("vec_id").collect()}
    got = sorted(r["image"] for r in catalog.QUERIES["kernel_similarity"](spark, sf_dir).collect())
    assert got == sorted(i for i in images if i + 1 in images) and any(i % 2 for i in got)
    assert "% 2 = 0" not in catalog.ORACLE_SQL["kernel_similarity"]
