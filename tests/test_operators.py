"""Operators against numpy and brute force, with their edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import models
from lumenlake.operators import extract, folds, learn, metrics, neardup, ordered, relational, resample


def scores(spark, n=400, seed=0, ties=20):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 60)), int(rng.random() < 0.4), float(rng.integers(0, ties)) / ties, float(rng.random())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "image long, patient_id long, target int, p double, q double").cache()


def pair_auc(y, s, w):
    y, s, w = map(np.asarray, (y, s, w))
    p, n = y == 1, y == 0
    won = (s[p][:, None] > s[n][None, :]) + 0.5 * (s[p][:, None] == s[n][None, :])
    return float((won * w[p][:, None] * w[n][None, :]).sum() / (w[p].sum() * w[n].sum()))


def test_sums_before(spark):
    rows = [("a", float(x), 1.0) for x in (-5, -0.5, 0, 0.001, 3, 1e6, 2e6)] + [("b", 1.0, 2.0)]
    out = ordered.sums_before(spark.createDataFrame(rows, "k string, x double, v double"), ["k"], "x", ["v"]).collect()
    assert {(r["k"], r["x"]): r["v_before"] for r in out if r["k"] == "a"} == {("a", x): float(i) for i, x in enumerate(sorted(r[1] for r in rows if r[0] == "a"))}
    down = ordered.sums_before(spark.createDataFrame(rows, "k string, x double, v double"), ["k"], "x", ["v"], descending=True)
    assert down.where("k = 'a' AND x = 2e6").first()["v_before"] == 0
    assert down.where("k = 'a' AND x = -5").first()["v_before"] == 6


def test_auc_is_the_pairwise_share(spark):
    rows, frame = scores(spark)
    y, size = [r[2] for r in rows], {}
    for r in rows:
        size[r[1]] = size.get(r[1], 0) + 1
    w = [1 / size[r[1]] for r in rows]
    weighted = relational.share_weight(frame, ["patient_id"], "w")
    for name, at in (("p", 3), ("q", 4)):
        s = [r[at] for r in rows]
        got = metrics.auc(weighted, [], "target", name, "w").first()["auc"]
        assert got == pytest.approx(pair_auc(y, s, w)) == pytest.approx(models.weighted_auc(np.array(y), np.array(s), np.array(w)))
        flipped = metrics.auc(weighted.withColumn(name, 1 - F.col(name)), [], "target", name, "w").first()["auc"]
        assert flipped == pytest.approx(1 - got)
    assert metrics.auc(frame.where("target = 1"), [], "target", "p").first()["auc"] is None


def test_average_precision_youden_and_rates(spark):
    rows, frame = scores(spark, seed=1)
    y, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    ap, recall = 0.0, 0.0
    best = None
    for t in sorted(set(s), reverse=True):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        ap += (tp / y.sum() - recall) * tp / (tp + fp)
        recall = tp / y.sum()
        j = tp / y.sum() - fp / (1 - y).sum()
        if best is None or j > best[0] + 1e-12:
            best = (j, t)
    assert metrics.average_precision(frame, [], "target", "p").first()["average_precision"] == pytest.approx(ap)
    assert metrics.youden(frame, [], "target", "p").first()["threshold"] == best[1]
    r = metrics.rates(metrics.confusion(frame, [], "target", F.col("p") >= 0.5)).first()
    tp, fp, fn, tn = (((s >= 0.5) == a) & (y == b) for a, b in ((True, 1), (True, 0), (False, 1), (False, 0)))
    assert r["tp"] == tp.sum() and r["mcc"] == pytest.approx(np.corrcoef(s >= 0.5, y)[0, 1])
    none = metrics.rates(metrics.confusion(frame, [], "target", F.lit(True))).first()
    assert none["mcc"] == 0 and none["specificity"] == 0
    assert metrics.youden(frame.where("target = 0"), [], "target", "p").first()["threshold"] == 0.5


def test_calibration_is_the_newton_solution(spark):
    rows, frame = scores(spark, seed=2)
    a, b = metrics.calibration(frame, "target", "q", F.lit(1.0), ridge=0.0)
    x = np.array([np.log(np.clip(r[4], 1e-6, 1 - 1e-6) / (1 - np.clip(r[4], 1e-6, 1 - 1e-6))) for r in rows])
    y = np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * x).sum()) < 1e-6


def test_weights(spark):
    _, frame = scores(spark, seed=3)
    data = frame.withColumn("dataset", F.when(F.col("image") % 3 == 0, "a").otherwise("b"))
    w = relational.stratum_weight(data, ["dataset", "target"], "patient_id")
    totals = relational.stratum_totals(w, ["dataset", "target"]).collect()
    assert all(r["balanced"] for r in totals) and sum(r["total"] for r in totals) == pytest.approx(400)
    assert relational.sampler_weight(data, ["dataset", "target"], "patient_id").agg(F.avg("weight")).first()[0] == pytest.approx(1)
    assert relational.normalised_weight(data, "patient_id").agg(F.sum("weight")).first()[0] == pytest.approx(data.select("patient_id").distinct().count())


def test_guards(spark):
    twice = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    once = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    with pytest.raises(Exception, match="not unique"):
        relational.join_one_to_one(once, twice, ["k"]).collect()
    with pytest.raises(Exception, match="not finite"):
        relational.require_finite(once, ["v"]).collect()
    with pytest.raises(Exception, match="occurs twice"):
        relational.align({"a": once.where("k = 1"), "b": twice}, ["k"], "v").collect()
    with pytest.raises(Exception, match="no family"):
        spark.range(1).select(relational.family(F.lit("zzz"), {"a": "b"})).collect()
    mixed = spark.createDataFrame([(1, "a", 0, 0.5), (1, "b", 1, 0.5)], "g int, label string, target int, p double")
    with pytest.raises(Exception, match="labels differ"):
        relational.collapse(mixed, "g", "label", "target", "p").collect()
    assert relational.missing_columns(once, ["k", "z", "a"]) == ["a", "z"]
    assert relational.nonfinite_counts(once, ["v"]).first()["v"] == 1


def test_scalars(spark):
    import hashlib

    row = spark.createDataFrame([("x", "YES"), ("y", None)], "n string, flag string").select("n", relational.truthy("flag").alias("t"), relational.hash_seed(F.lit(7), F.col("n")).alias("s")).collect()
    assert [r["t"] for r in row] == [True, False]
    want = int.from_bytes(hashlib.sha256(b"7|x").digest()[:8], "little") % (2**32 - 1)
    assert row[0]["s"] == want
    angle = spark.range(1).select(relational.wrapped_angle(F.lit(3 * np.pi + 0.5)).alias("a")).first()["a"]
    assert angle == pytest.approx(-np.pi + 0.5)


def test_benjamini_hochberg_is_monotone(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.9]
    frame = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "f string, i int, p double")
    q = [r["q"] for r in metrics.benjamini_hochberg(frame, ["f"], "p", ["i"]).orderBy("p").collect()]
    assert q == sorted(q) and q[0] == pytest.approx(0.01) and q[1] == pytest.approx(0.04) and max(q) <= 1


def test_bootstrap_weights_equal_resampled_rows(spark):
    rows, frame = scores(spark, n=120, seed=4)
    units = sorted({r[1] for r in rows})
    draws = resample.numpy_draws(spark, units, "patient_id", 5, 11)
    got = {r["iteration"]: r["p"] for r in resample.replicate_auc(frame, draws, "patient_id", "target", ["p", "q"]).collect()}
    rng = np.random.default_rng(11)
    for i in range(5):
        y, s, w = [], [], []
        for u in rng.choice(len(units), size=len(units), replace=True):
            own = [r for r in rows if r[1] == units[u]]
            y += [r[2] for r in own]
            s += [r[3] for r in own]
            w += [1 / len(own)] * len(own)
        assert got[i] == pytest.approx(pair_auc(y, s, w))
    hashed = resample.hash_draws(resample.numbered(frame, "patient_id"), "patient_id", 7, "s")
    sums = hashed.groupBy("iteration").agg(F.sum("m").alias("m")).collect()
    assert len(sums) == 7 and all(r["m"] == len(units) for r in sums)
    d = resample.paired_intervals(resample.replicate_auc(frame, hashed, "patient_id", "target", ["p", "q"]), ["p", "q"], "p").first()
    assert d["ci_low"] <= d["mean"] <= d["ci_high"] and 0 <= d["p_value"] <= 1


def test_folds_keep_groups_whole(spark):
    _, frame = scores(spark, seed=5)
    for table in (folds.stratified_folds(frame, "patient_id", "target", 4, 1), folds.hash_folds(frame, "patient_id", "target", 4, "s")):
        audit = folds.fold_audit(frame, table, "patient_id", "target").collect()
        assert len(audit) == 4 and all(r["leaks"] == 0 and r["benign"] and r["malignant"] for r in audit)
        assert sum(r["rows"] for r in audit) == 400
    leaky = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "patient_id long, fold int")
    assert sum(r["leaks"] for r in folds.fold_audit(frame, leaky, "patient_id", "target").collect()) == 2
    with pytest.raises(RuntimeError):
        folds.stratified_folds(frame.withColumn("target", F.lit(1)), "patient_id", "target", 4, 1, attempts=2)
    split = folds.group_split(frame, "patient_id", ["target"], 0.2, 3)
    assert split.groupBy("patient_id").count().where("count > 1").isEmpty()


def test_hamming_pairs_are_complete(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40).tolist()
    hashes = base + [b ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for b in base] + [base[0], base[0]]
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)] + [(999, None)], "k long, h long")
    for distance in (0, 2, 5):
        got = {(r["first"], r["second"], r["hamming"]) for r in neardup.hamming_pairs(frame, "k", "h", distance).collect()}
        want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= distance}
        assert got == want


def test_constant_bits_make_no_large_bucket(spark):
    """Half of the bits are constant: their bands would hold every hash, so they are split by the others."""
    rng = np.random.default_rng(4)
    hashes = sorted({int(x) << 20 for x in rng.integers(0, 1 << 14, 1200)})
    frame = spark.createDataFrame(list(enumerate(hashes)), "k long, h long")
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 3}
    got = neardup.hamming_pairs(frame, "k", "h", 3, 64, most=50)
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    order = neardup.bit_order(frame, "h", 64)
    assert set(order[:14]) == set(range(20, 34)) and sorted(order) == list(range(64))
    assert sorted(b for band in neardup.bands(order, 3) for b in band) == list(range(64))
    assert all(any(b in order[:14] for b in band) for band in neardup.bands(order, 3))


@pytest.mark.parametrize("in_block", [40, 16_384])
def test_a_large_distance_compares_blocks_in_a_plan_of_fixed_size(spark, monkeypatch, in_block):
    """Bands of three bits would split again and again, until their names alone fill the driver."""
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 63, 600).tolist() + [int(x) - (1 << 63) for x in rng.integers(0, 1 << 63, 20)]
    hashes += [h ^ sum(1 << int(b) for b in rng.choice(63, 18 + i % 2, replace=False)) for i, h in enumerate(hashes[:60])] + hashes[:5]
    frame = spark.createDataFrame(list(enumerate(hashes)) + [(9999, None)], "k long, h long")
    want = sorted((i, j, ((a ^ b) % (1 << 64)).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and ((a ^ b) % (1 << 64)).bit_count() <= 18)
    monkeypatch.setattr(neardup._near_in_blocks, "__defaults__", (in_block,))
    got = neardup.hamming_pairs(frame, "k", "h", 18, 64, most=20)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(got._jdf.queryExecution().executedPlan().toString()) < 50_000


def test_too_many_splits_go_to_blocks(spark, monkeypatch):
    hashes = sorted({int(x) << 20 for x in np.random.default_rng(4).integers(0, 1 << 14, 900)})
    frame = spark.createDataFrame(list(enumerate(hashes)), "k long, h long")
    want = sorted(map(tuple, neardup.hamming_pairs(frame, "k", "h", 3, 64, most=50).collect()))
    monkeypatch.setattr(neardup, "MOST_BANDS", 3)
    assert sorted(map(tuple, neardup.hamming_pairs(frame, "k", "h", 3, 64, most=50).collect())) == want and want


def test_component_labels_of_a_long_chain(spark):
    """The planner's estimate stays with the table, and a chain settles in few steps."""
    n = 100_000
    spread = lambda c: (c * 7919) % n
    edges = spark.range(n - 1).select(spread(F.col("id")).alias("first"), spread(F.col("id") + 1).alias("second"))
    got = neardup.component_labels(spark.range(n + 5).select(F.col("id").alias("node")), edges)
    assert int(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 50
    counts = {r["root"]: r["count"] for r in got.groupBy("root").count().collect()}
    assert counts == {0: n} | {n + i: 1 for i in range(5)}


def test_component_labels(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(40, 50), (50, 45), (45, 45)], "first long, second long")
    got = {r["node"]: r["root"] for r in neardup.component_labels(nodes, edges).collect()}
    assert {got[i] for i in range(30)} == {0} and got[50] == got[45] == 40 and got[59] == 59
    attributes = nodes.withColumn("label", F.when(F.col("node") == 50, "x").otherwise("y"))
    groups = {r["node"]: r for r in neardup.visual_groups(spark.createDataFrame(list(got.items()), "node long, root long"), attributes, "label").collect()}
    assert groups[45]["cross_label_conflict"] and not groups[45]["is_valid"] and groups[3]["group_size"] == 30


def test_logistic_paths_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x @ [1, -2, 0.5] + rng.normal(size=300) > 0.3).astype(int)
    frame = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int")
    rows = learn.balanced_weight(learn.standardised(frame, learn.scaling(frame, ["a", "b", "c"])), "y")
    coef, constant = learn.fit_logistic(rows, ["a", "b", "c"], "y", "class_weight", c=0.5)
    local = models.Logistic(0.5).fit(x, y)
    assert np.allclose(coef, local.coef, atol=1e-5) and constant == pytest.approx(local.constant, abs=1e-5)


@pytest.mark.parametrize("name,params", [("logistic", {}), ("linear_svm", {"c": 0.1, "epochs": 5}), ("rbf_svm", {}), ("random_forest", {"trees": 15}), ("extra_trees", {"trees": 15}), ("boosted", {"rounds": 30}), ("adaptive", {"rounds": 30}), ("embedded", {"k": 4})])
def test_models_learn(name, params):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    fitted = models.make(name, params).fit(x[:160], y[:160])
    assert models.weighted_auc(y[160:], fitted.score(x[160:])) > 0.85


def test_grids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i // 3, int(rng.random() < 0.5)) for i in range(90)]
    frame = spark.createDataFrame([(*r, float(r[2] + rng.normal()), float(rng.normal())) for r in rows], "image long, patient_id long, target int, a double, b double")
    table = folds.hash_folds(frame, "patient_id", "target", 3, "x").withColumn("repeat", F.lit(0))
    out = learn.grid_scores(frame, table, ["image", "patient_id"], ["a", "b"], "target", "patient_id", "logistic", [{"c": 1.0}, {"c": 0.01}])
    assert out.groupBy("param_id").count().collect()[0]["count"] == 90
    assert learn.tune(out, "patient_id", "target").first()["auc"] > 0.6


def test_extraction_keeps_failures(spark):
    y, x = np.mgrid[:40, :40]
    image, mask = (x + np.sin(y)).ravel().tolist(), (((x - 20) ** 2 + (y - 20) ** 2) < 150).astype(int).ravel().tolist()
    rows = [("good", 40, 40, image, mask), ("empty", 40, 40, image, [0] * 1600), ("none", 40, 40, None, mask), ("short", 40, 40, image[:10], mask)]
    frame = spark.createDataFrame(rows, "image string, height int, width int, pixels array<double>, mask array<int>")
    out = {r["image"]: r for r in extract.extract(frame, ["image"], ["basic", "fractal"]).collect()}
    assert out["good"]["failure"] is None and out["good"]["basic_mean"] is not None
    assert all(out[k]["failure"] and out[k]["basic_mean"] is None for k in ("empty", "none", "short"))
    logged = []
    with pytest.raises(RuntimeError, match="3 images"):
        extract.require_extracted(extract.extract(frame, ["image"], ["basic"]), lambda f: logged.append(f.count()))
    assert logged == [3]
    assert extract.extract(frame.limit(0), ["image"], ["basic"]).count() == 0
    audit = {r["image"]: r for r in extract.audited(frame.where("image <> 'short'"), ["image"]).collect()}
    assert audit["good"]["mask_foreground_pixels"] == sum(mask) and len(audit["good"]["dhash64"]) == 16 and audit["none"]["pixel_sha256"] is None
    pairs = spark.createDataFrame([("good", "empty", 0)], "first string, second string, hamming int")
    assert extract.confirmed_pairs(pairs, frame, "image").first()["ssim_256"] == pytest.approx(1.0)


def test_gates(spark):
    from lumenlake.operators import gates

    table = spark.createDataFrame([("a", 0.8, 0.7, 0.01), ("b", 0.75, 0.75, -0.02)], "dataset string, auc double, reference_auc double, ci_low double")
    assert gates.primary_supported(table).first()["supported"]
    assert not gates.primary_supported(table.withColumn("ci_low", F.lit(-1.0))).first()["supported"]
    early = spark.createDataFrame([("a", 0.02, 0.97), ("b", -0.005, 0.4)], "dataset string, mean double, p_positive double")
    assert gates.early_promoted(early).first()["promoted"]
    assert not gates.early_promoted(early.withColumn("mean", F.col("mean") - 0.01)).first()["promoted"]
    deltas = spark.createDataFrame([("locked_external", "ws46", 0.0, -0.1), ("lodo", "ws46", 0.02, -0.1), ("lodo", "x", -1.0, -1.0)], "context string, ablated_model string, point_delta double, delta_ci_low double")
    scores_table = spark.createDataFrame([("full", 0.8), ("ws46", 0.78)], "model string, auc double")
    row = gates.block_claim(deltas, scores_table, "full", "ws46").first()
    assert (row["external"], row["mean_gain"], row["no_loss"], row["retained"]) == (False, True, True, True)


def test_units_of_one_beginning_are_numbered_in_ranges(spark):
    from lumenlake.operators import resample

    for names in ([f"patient_{i:05d}" for i in range(3000)], ["a"], ["a", "ab", "abc", "abd", "b"], ["x", "xy"], [None, "q"]):
        frame = spark.createDataFrame([(n,) for n in names * 2], "unit string")
        found = {r["unit"]: r["n"] for r in resample.numbered(frame, "unit").collect()}
        assert found == {n: i for i, n in enumerate(sorted(x for x in names if x is not None))}
    assert resample.numbered(spark.createDataFrame([], "unit string"), "unit").collect() == []


def test_weighted_draws_follow_the_weights(spark):
    from lumenlake.operators import resample

    frame = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 3.0), (4, None), (None, 9.0), (5000, 4.0), (6, -1.0)], "k long, w double")
    drawn = resample.weighted_draws(frame, "k", "w", 4000, "s").collect()
    assert sorted(r["draw"] for r in drawn) == list(range(4000))
    share = {k: sum(r["k"] == k for r in drawn) / 4000 for k in (1, 3, 5000)}
    assert abs(share[1] - 0.125) < 0.03 and abs(share[3] - 0.375) < 0.03 and abs(share[5000] - 0.5) < 0.03
    assert resample.weighted_draws(frame.limit(0), "k", "w", 5, "s").collect() == []


def test_stretch_lookup_is_one_short_expression(spark):
    from lumenlake.operators.ordered import stretch_of

    cuts = sorted([float(3 * i) for i in range(190)] + [15.0, 15.0])
    rows = spark.createDataFrame([(v,) for v in (None, -1.0, 0.0, 1.0, 15.0, 15.5, 300.0, 567.0, 1e9)], "v double")
    at, single = stretch_of(F.col("v"), cuts)
    plan = rows.select(at.alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 5  # a comparison for each place of a chunk, repeated in each other, was too long to be compiled
    got = rows.select("v", at.alias("a"), single.alias("s")).collect()
    once = sorted(set(cuts))
    for r in got:
        if r["v"] is None:
            assert r["a"] == 0
        else:
            assert r["a"] == 2 * sum(c < r["v"] for c in once) + (r["v"] == 15.0) and r["s"] == (r["v"] == 15.0)
