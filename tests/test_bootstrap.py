"""Matrix bootstrap against plain numpy on the same multiplicities, and the cut points that it and the rank metrics use."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions.models import weighted_auc
from lumenlake.operators import bootstrap, metrics, ordered, resample


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        y = int(rng.random() < 0.4)
        score = round(float(y + rng.normal()), 1) if i % 3 else 0.5  # a third of the rows share one score
        rows.append((i, f"p{i % 400 if i % 10 else 7}", "ab"[i % 2], y, score, float(rng.normal())))
    rows.append((9999, "x", "a", 1, 0.5, 0.1))
    return spark.createDataFrame(rows, "image long, patient string, dataset string, target int, score double, fine double").repartition(5).cache()


def multiplicities(rows, draws):
    """{unit: vector} of what the tasks would make."""
    units = rows.select("patient", "_number", "_extra").distinct().collect()
    out = {}
    for r in units:
        m = draws.poisson(np.array([r["_number"]]))[0].astype(int)
        np.add.at(m, r["_extra"], 1)
        out[r["patient"]] = m
    return out


def test_every_replicate_draws_as_many_units_as_there_are(cohort):
    rows, draws = bootstrap.drawn(cohort, "patient", 60, 3)
    m = np.array(list(multiplicities(rows, draws).values()))
    assert bootstrap.closeness(len(m)) > 0 and (m.sum(0) == len(m)).all()
    assert rows.count() == cohort.count()
    share = np.bincount(m.ravel(), minlength=6)[:6] / m.size  # of a multinomial deal: nearly Poisson of mean 1
    assert np.abs(share - np.exp(-1) / np.array([1, 1, 2, 6, 24, 120])).max() < 0.02
    assert abs(np.corrcoef(m[:, 0], m[:, 1])[0, 1]) < 0.2


@pytest.mark.parametrize("units", [1, 3, 40, 5000, 10**6, 10**12])
def test_thresholds(units):
    cuts = bootstrap.thresholds(units)
    assert cuts == sorted(set(cuts)) and all(0 < c < 2**32 for c in cuts)
    assert bool(cuts) == (bootstrap.closeness(units) > 0)


def test_numbers_have_the_poisson_mean():
    draws = bootstrap.Draws(200, 1, 10_000)
    m = draws.poisson(np.arange(3000) + (1 << 33))
    mean = 1 - 2.0 ** -bootstrap.closeness(10_000)
    assert m.mean() == pytest.approx(mean, abs=0.005) and m.var() == pytest.approx(mean, abs=0.01)
    picked = draws.topped(3, 50_000)
    assert picked.min() >= 0 and picked.max() < 10_000 and abs(picked.mean() - 5000) < 60


def brute(rows, m, score, keep=lambda r: True, share=True):
    rows = [r for r in rows if keep(r)]
    y = np.array([r["target"] for r in rows])
    s = np.array([r[score] for r in rows])
    names = [r["patient"] for r in rows]
    count = {n: names.count(n) for n in set(names)}
    w = np.array([1 / count[n] if share else 1.0 for n in names])
    big = np.array([m[n] for n in names])
    return [weighted_auc(y, s, w * big[:, i]) for i in range(big.shape[1])]


def test_replicate_auc_equals_numpy(cohort):
    rows, draws = bootstrap.drawn(cohort, "patient", 25, 3)
    m = multiplicities(rows, draws)
    data = cohort.collect()
    got = {r["iteration"]: r for r in bootstrap.replicate_auc(rows, draws, "patient", "target", ["score", "fine"]).collect()}
    for name in ("score", "fine"):
        expected = brute(data, m, name)
        assert len(got) == 25 and all(got[i][name] == pytest.approx(expected[i], abs=1e-12) for i in range(25))
    by_set = bootstrap.replicate_auc(rows, draws, "patient", "target", ["score"], ["dataset"]).collect()
    for d in "ab":
        expected = brute(data, m, "score", lambda r: r["dataset"] == d)
        own = {r["iteration"]: r["score"] for r in by_set if r["dataset"] == d}
        assert all(own[i] == pytest.approx(expected[i], abs=1e-12) for i in range(25))


def test_iterations_in_several_parts_and_small_batches(spark, cohort, monkeypatch):
    rows, draws = bootstrap.drawn(cohort, "patient", 25, 3)
    whole = {r["iteration"]: r["fine"] for r in bootstrap.replicate_auc(rows, draws, "patient", "target", ["fine"]).collect()}
    monkeypatch.setattr(bootstrap, "ITERATIONS_AT_ONCE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        parts = {r["iteration"]: r["fine"] for r in bootstrap.replicate_auc(rows, draws, "patient", "target", ["fine"]).collect()}
        tied = {r["iteration"]: r["score"] for r in bootstrap.replicate_auc(rows, draws, "patient", "target", ["score"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts == pytest.approx(whole)
    assert [tied[i] for i in range(25)] == pytest.approx(brute(cohort.collect(), multiplicities(rows, draws), "score"))


def test_average_precision_equals_numpy(spark, cohort):
    rows, draws = bootstrap.drawn(cohort.withColumn("one", F.lit(1.0)), "patient", 12, 8)
    m = multiplicities(rows, draws)
    data = cohort.collect()

    def plain(score, i, keep):
        own = [r for r in data if keep(r)]
        total = gained = tp = taken = 0.0
        for s in sorted({r[score] for r in own}, reverse=True):
            here = [(r["target"], m[r["patient"]][i]) for r in own if r[score] == s]
            p, n = sum(w for y, w in here if y), sum(w for y, w in here if not y)
            tp, taken, total = tp + p, taken + p + n, total + p
            gained += p * tp / taken if taken else 0
        return gained / total

    for size in ("10000", "4"):  # batches that hold whole stretches, and parts of one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for score in ("score", "fine") if size == "4" else ("fine",):
            got = {r["iteration"]: r["average_precision"] for r in bootstrap.replicate_average_precision(rows, draws, "target", score, "one").collect()}
            assert [got[i] for i in range(12)] == pytest.approx([plain(score, i, lambda r: True) for i in range(12)])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keyed = bootstrap.replicate_average_precision(rows, draws, "target", "score", "one", ["dataset"]).where("dataset = 'b'").collect()
    assert {r["iteration"]: r["average_precision"] for r in keyed} == pytest.approx({i: plain("score", i, lambda r: r["dataset"] == "b") for i in range(12)})


def test_summed_and_factorial(cohort):
    rows, draws = bootstrap.drawn(cohort, "patient", 15, 4)
    m = multiplicities(rows, draws)
    got = {(r["dataset"], r["iteration"]): r["fine"] for r in bootstrap.summed(rows, draws, ["fine"], ["dataset"]).collect()}
    for d in "ab":
        for i in range(15):
            assert got[d, i] == pytest.approx(sum(r["fine"] * m[r["patient"]][i] for r in cohort.collect() if r["dataset"] == d))
    both = bootstrap.replicate_auc(rows, draws, "patient", "target", ["score", "fine"], ["dataset"])
    table, audit = bootstrap.factorial_deltas(both, "score", ["fine"], ["dataset"])
    found = {r["dataset"]: r for r in table.collect()}
    a = brute(cohort.collect(), m, "score", lambda r: r["dataset"] == "a")
    b = brute(cohort.collect(), m, "fine", lambda r: r["dataset"] == "a")
    assert found["a"]["mean"] == pytest.approx(np.mean(np.subtract(a, b)))
    assert {(r["dataset"], r["replicates"], r["failed"]) for r in audit.collect()} == {("a", 15, False), ("b", 15, False)}
    none = bootstrap.replicate_auc(rows.where("target = 1"), draws, "patient", "target", ["score", "fine"])
    assert [(r["replicates"], r["failed"]) for r in bootstrap.factorial_deltas(none, "score", ["fine"])[1].collect()] == [(0, True)]


def test_no_draws_of_nobody(cohort):
    rows, draws = bootstrap.drawn(cohort.limit(0), "patient", 5, 1)
    assert draws.units == 0 and bootstrap.replicate_auc(rows, draws, "patient", "target", ["score"]).count() == 0


# ------------------------------------------------------------------ cut points


def stretches(frame, column, cuts):
    at, single = ordered.stretch_of(F.col(column), cuts)
    return frame.withColumn("at", at).withColumn("single", single)


def test_skewed_scores_leave_no_large_stretch(spark):
    """Most scores crowd within a millionth, a third is one value, and one stray value lies far away."""
    rng = np.random.default_rng(2)
    values = np.concatenate([0.5 + rng.random(20_000) * 1e-6, np.full(10_000, 0.25), [1e12, -1e12]])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    cuts = ordered.cut_points(frame, "v")
    rows = stretches(frame, "v", cuts)
    sizes = {(r["at"], r["single"]): r["count"] for r in rows.groupBy("at", "single").count().collect()}
    assert [n for (_, single), n in sizes.items() if single] == [10_000]
    assert max(n for (_, single), n in sizes.items() if not single) <= 0.01 * len(values)
    order = rows.groupBy("at").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("at").collect()
    assert all(a["high"] < b["low"] for a, b in zip(order, order[1:], strict=False))


def test_stray_units_leave_no_large_range(spark):
    units = spark.createDataFrame([(f"patient_{i:06d}",) for i in range(30_000)] + [("x",), ("a",)], "u string")
    cuts = ordered.text_cut_points(units, "u")
    sizes = [r["count"] for r in stretches(units, "u", cuts).groupBy("at").count().collect()]
    assert max(sizes) <= 0.01 * 30_002
    numbers = {r["u"]: r["n"] for r in resample.numbered(units.union(units.limit(50)), "u").collect()}
    assert [u for u, _ in sorted(numbers.items(), key=lambda x: x[1])] == sorted(numbers) and sorted(numbers.values()) == list(range(30_002))


def test_running_sums_over_crowded_values(spark):
    rng = np.random.default_rng(6)
    v = np.unique(np.concatenate([rng.random(3000) * 1e-9, [5.0, -7.0]]))
    rows = [(k, float(x), int(i % 5)) for k in "ab" for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "k string, v double, n long")
    got = {(r["k"], r["v"]): r["n_before"] for r in ordered.sums_before(frame, ["k"], "v", ["n"]).collect()}
    run = np.cumsum([i % 5 for i in range(len(v))])
    assert all(got["a", float(x)] == run[i] - i % 5 for i, x in enumerate(v))
    down = {(r["k"], r["v"]): r["n_before"] for r in ordered.sums_before(frame, ["k"], "v", ["n"], descending=True).collect()}
    assert all(down["b", float(x)] == run[-1] - run[i] for i, x in enumerate(v))
    assert ordered.sums_before(frame.limit(0), ["k"], "v", ["n"]).count() == 0
    assert metrics.auc(frame.withColumn("y", (F.col("n") > 2).cast("int")), ["k"], "y", "v").count() == 2


def test_utility_deltas_take_four_means_a_unit(spark):
    from lumenlake.operators import resample

    draw = np.random.default_rng(12)
    rows = [(int(u), int(y), float(a), float(b)) for u, y, a, b in zip(draw.integers(0, 40, 500), draw.integers(0, 2, 500), draw.choice([0.0, 0.1, 0.35, 0.8, 0.9], 500), draw.random(500), strict=True)]
    frame = spark.createDataFrame(rows, "unit long, target int, a double, b double")
    want = resample.unit_deltas(resample.unit_table(frame, "unit", "target", "a"), resample.unit_table(frame, "unit", "target", "b"), "unit")
    got = resample.utility_deltas(frame, "unit", "target", "a", "b")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("avg(") == 4
    want, got = ({r["unit"]: (r["brier_delta"], r["net_benefit_delta"]) for r in f.collect()} for f in (want, got))
    assert set(want) == set(got) and all(got[u] == pytest.approx(want[u], abs=1e-12) for u in want)
