"""Whole studies on small synthetic tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import learn
from lumenlake.plans import studies


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.5)
        rows.append((f"i{i:03d}", f"p{i // 2:03d}", ["a", "b", "c"][i % 3], y, float(y + rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "image string, patient_id string, dataset string, target int, good double, noise double").cache()


def test_grouped_cv(cohort):
    out = studies.grouped_cv(cohort, {"good": ["good"], "noise": ["noise"]}, 3, 2, 2, [0.1, 1.0]).cache()
    assert out.count() == 2 * 2 * 240
    wide, table, deltas = studies.cv_summary(out, ["good", "noise"], "good", 15)
    auc = {r["group"]: r["auc"] for r in table.collect()}
    assert wide.count() == 240 and auc["good"] > 0.68 > auc["noise"]
    d = deltas.first()
    assert d["score"] == "probability_noise" and d["ci_high"] < 0


def test_locked_evaluation(cohort):
    wide = studies.locked_predictions(cohort, ["a", "b"], ["c"], ["good", "noise"], {"c": 1.0}).cache()
    assert wide.count() == 80 and {"probability_a", "probability_b", "probability_ensemble"} <= set(wide.columns)
    row = wide.first()
    assert row["probability_ensemble"] == pytest.approx((row["probability_a"] + row["probability_b"]) / 2)
    t = studies.source_threshold(cohort, "a", ["good"], 3, {"c": 1.0}, 7)
    m = studies.external_metrics(wide, "probability_ensemble", t)
    assert len(m) == 13 and m["group_balanced_roc_auc"] > 0.65 and 0 <= m["ece_10"] <= 1 and 0 < t < 1
    table = studies.compared_methods(wide, ["probability_a", "probability_b", "probability_ensemble"], "probability_a", 10).collect()
    assert len(table) == 2 and all(r["q"] >= r["p_value"] - 1e-12 for r in table)


def test_transfer(spark, cohort):
    names = ["a", "b", "c"]
    plan = [(f"{s}>{t}", part, s if part == "train" else t) for s in names for t in names if s != t for part in ("train", "test")]
    scores = learn.transfer_scores(cohort, spark.createDataFrame(plan, "run string, part string, dataset string"), ["image", "patient_id"], ["good"], "target", "dataset", "logistic", {"c": 1.0})
    matrix = {r["source"]: r for r in studies.transfer_matrix(scores, names).collect()}
    assert matrix["a"]["a"] is None and matrix["a"]["b"] > 0.6


def test_manifests(spark):
    info = spark.createDataFrame([("p1_a.png", "8x6", "Benign", "false", "0", "No"), ("p1_b.png", "8x6", "Malignant", "false", "0", "No"), ("p2_a.png", "8x6", "Normal", "true", "0", "No"), ("p3.png", "9x9", "Benign", "0", "yes", "0")], "image string, resolution string, label string, doppler string, marks string, combined string")
    files = spark.createDataFrame([(n, 6, 8, "s") for n in ("p1_a.png", "p1_b.png", "p2_a.png", "p3.png")], "name string, height int, width int, sha256 string")
    colours = spark.createDataFrame([("p1_a.png", 0, 5, 5), ("p1_b.png", 0, 3, 3), ("p2_a.png", 0, 0, 0), ("p3.png", 0, 4, 4)], "name string, red_pixels long, green_pixels long, foreground_pixels long")
    got = {r["image"]: r for r in studies.colour_manifest(info, files, files, colours).collect()}
    assert [got[n]["is_clean_primary"] for n in sorted(got)] == [True, False, False, False]
    assert got["p1_b.png"]["patient_id"] == "p1" and not got["p1_b.png"]["color_consistent"] and not got["p3.png"]["geometry_consistent"]
    gaps = {tuple(r) for r in studies.unreconciled(info, files.where("name <> 'p3.png'"), files.unionByName(spark.createDataFrame([("x.png", 1, 1, "s")], files.schema))).collect()}
    assert gaps == {("p3.png", "images"), ("x.png", "metadata"), ("x.png", "images")}
    rows = spark.createDataFrame([("d", n, "p", lab) for n, lab in (("a", "benign"), ("b", "normal"), ("c", "benign"), ("e", "malignant"), ("f", "malignant"), ("g", "benign"))], "dataset string, image string, patient_id string, label string")
    images = spark.createDataFrame([(n, 4, 4) for n in "abcef"], "image string, width int, height int")
    masks = spark.createDataFrame([("a", 4, 4, 3), ("b", 4, 4, 3), ("e", 5, 4, 3), ("f", 4, 4, 0)], "image string, mask_width int, mask_height int, mask_foreground_pixels long")
    reasons = {r["image"]: r["exclusion_reason"] for r in studies.external_manifest(rows, images, masks).collect()}
    assert reasons == {"a": "", "b": "unsupported_label", "c": "missing_mask", "e": "geometry_mismatch", "f": "empty_mask", "g": "missing_image"}


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    base = [np.clip(np.kron(rng.integers(0, 255, (8, 8)), np.ones((8, 8))) + 0, 0, 255) for _ in range(3)]
    planes = {"a": base[0], "b": np.clip(base[0] + rng.integers(-2, 3, (64, 64)), 0, 255), "c": base[1], "d": base[2]}
    rows = [(k, "x" if k != "b" else "y", 64, 64, p.ravel().astype(float).tolist(), [1] * 4096) for k, p in planes.items()]
    frame = spark.createDataFrame(rows, "image string, label string, height int, width int, pixels array<double>, mask array<int>")
    got = {r["image"]: r for r in studies.near_duplicate_manifest(frame, "image", "label").collect()}
    assert got["a"]["group_id"] == got["b"]["group_id"] == "visual_group_0001" and got["a"]["cross_label_conflict"] and not got["b"]["is_valid"]
    assert got["c"]["group_size"] == 1 and got["d"]["is_valid"]
    assert frame.where(F.col("image") == "a").count() == 1
