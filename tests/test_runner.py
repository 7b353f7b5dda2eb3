"""A study that is stopped goes on where it stood, and a locked evaluation through it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.plans import locked
from lumenlake.plans.runner import Runner, content_digest
from lumenlake.plans.studies import external_metrics


def stages(runner, rows, factor, fail=False):
    def third(table, **_):
        if fail:
            raise RuntimeError("killed")
        return table.where("v % 2 = 0")

    one = runner.run("one", lambda: rows)
    two = runner.run("two", lambda table, factor: table.withColumn("v", F.col("v") * factor), {"table": one}, factor=factor)
    return runner.run("three", third, {"table": two}, cut=2)


def test_a_killed_stage_is_resumed(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("v"))
    folder = str(tmp_path / "study")
    first = Runner(spark, folder)
    with pytest.raises(RuntimeError, match="killed"):
        stages(first, rows, 3, fail=True)
    assert first.computed == ["one", "two"]
    ledger = {r["stage"]: r for r in Runner(spark, folder).ledger().collect()}
    assert ledger["three"]["status"] == "failed" and "killed" in ledger["three"]["reason"] and ledger["two"]["rows"] == 10
    second = Runner(spark, folder)
    out = stages(second, rows, 3)
    assert second.found == ["one", "two"] and second.computed == ["three"]
    assert sorted(r["v"] for r in out.table.collect()) == [0, 6, 12, 18, 24]
    third = Runner(spark, folder)
    again = stages(third, rows, 3)
    assert third.computed == [] and again.entry == out.entry
    fourth = Runner(spark, folder)  # a changed parameter runs what follows as well
    stages(fourth, rows, 5)
    assert fourth.found == ["one"] and fourth.computed == ["two", "three"]


def test_an_equal_input_reruns_nothing_and_a_changed_one_does(spark, tmp_path):
    folder = str(tmp_path / "study")
    runner = Runner(spark, folder)
    a = runner.run("a", lambda x: spark.range(5), x=1)
    runner.run("b", lambda t: t, {"t": a})
    same = Runner(spark, folder)
    b = same.run("b", lambda t: t, {"t": same.run("a", lambda x: spark.range(5).repartition(3), x=2)})  # other parameters, same rows
    assert same.computed == ["a"] and same.found == ["b"] and b.entry["rows"] == 5
    other = Runner(spark, folder)
    other.run("b", lambda t: t, {"t": other.run("a", lambda x: spark.range(6), x=3)})
    assert other.computed == ["a", "b"]


def test_content_digest(spark):
    rows = [(1, "a", None), (2, None, 1.5), (2, None, 1.5)]
    frame = spark.createDataFrame(rows, "k long, s string, x double")
    assert content_digest(frame) == content_digest(frame.orderBy(F.desc("k")).select("x", "k", "s").repartition(3))
    assert content_digest(frame)[1] != content_digest(frame.distinct())[1] and content_digest(frame)[0] == 3
    assert content_digest(frame)[1] != content_digest(frame.withColumn("s", F.coalesce("s", F.lit(""))))[1]
    assert content_digest(frame.limit(0))[0] == 0


def test_locked_evaluation_resumes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, f"p{i // 2}", "abc"[i % 3], int(rng.random() < 0.5)) for i in range(240)]
    rows = [(*r, float(r[3] + rng.normal()), float(rng.normal()), *map(float, rng.normal(size=4) + r[3] * 0.7)) for r in rows]
    frame = spark.createDataFrame(rows, "image long, patient_id string, dataset string, target int, h0 double, h1 double, e0 double, e1 double, e2 double, e3 double")
    protocol = locked.Protocol(["h0", "h1"], ["e0", "e1", "e2", "e3"], k=3, cs=(1.0,), repeats=1, n_folds=2, machines={"linear_machine": None})
    folder = str(tmp_path / "study")
    monkeypatch.setattr(locked, "measured", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        locked.evaluate(Runner(spark, folder), frame, "a", ["b", "c"], protocol)
    monkeypatch.undo()
    runner = Runner(spark, folder)
    got = locked.evaluate(runner, frame, "a", ["b", "c"], protocol).toPandas()
    assert runner.computed == ["measured"] and runner.found == ["cohort", "out_of_fold", "chosen", "scaled", "scored"]
    assert len(got) == 5 * 2 * 13 and set(got.method) == set(locked.METHODS) - {"kernel_machine"}
    auc = got[got.metric == "group_balanced_roc_auc"].set_index(["method", "dataset"])["value"]
    assert (auc > 0.6).all() and auc.loc[("fusion", "b")] > 0.7
    sides = got[got.metric.isin(["sensitivity", "specificity"])]["value"]
    assert sides.between(0.2, 1).all()
    stored = Runner(spark, folder)
    mine = spark.read.parquet(stored._read("scored")["path"]).where("method = 'fusion' AND dataset = 'c'")
    threshold = spark.read.parquet(stored._read("scaled")["path"]).where("method = 'fusion'").first()["threshold"]
    alone = external_metrics(mine, "probability", threshold)
    own = got[(got.method == "fusion") & (got.dataset == "c")].set_index("metric")["value"]
    assert own.to_dict() == pytest.approx(alone, abs=1e-8)
    scores = spark.read.parquet(Runner(spark, folder)._read("scored")["path"]).toPandas()
    wide = scores.pivot(index=["dataset", "image"], columns="method", values="probability")
    assert np.allclose(wide["mean_fusion"], (wide["hand"] + wide["embedding"]) / 2) and wide.min().min() >= 0 and wide.max().max() <= 1


def test_locked_evaluation_tunes_by_the_whole_protocol(spark, sf_dir, monkeypatch):
    """Five values of C, five repeats and all landmarks, also for the machines."""
    from lumenlake.operators import kernels, selection
    from lumenlake.plans import learn_queries

    seen = []
    monkeypatch.setattr(locked, "evaluate", lambda runner, frame, source, targets, protocol: seen.append(protocol))
    learn_queries.locked_evaluation(spark, sf_dir)
    assert tuple(seen[0].cs) == selection.C_GRID and len(seen[0].cs) == 5 and (seen[0].repeats, seen[0].n_folds, seen[0].landmarks) == (5, 4, kernels.LANDMARKS)
    rng = np.random.default_rng(5)
    rows = [(i, f"p{i // 2}", i // 2 % 2, float(i // 2 % 2 + rng.normal()), float(rng.normal())) for i in range(80)]
    frame = spark.createDataFrame(rows, "image long, patient_id string, target int, a double, b double")
    protocol = locked.Protocol(["a"], ["a", "b"], k=2, cs=(0.1, 1.0), repeats=2, n_folds=2, landmarks=5)
    monkeypatch.setattr(locked.selection, "out_of_fold", lambda *a: spark.createDataFrame([], "subset string, c double, repeat int, image long, patient_id string, target int, probability double"))
    got = locked.out_of_fold(frame, protocol).groupBy("method", "c", "repeat").count().collect()
    assert sorted((r["method"], r["c"], r["repeat"], r["count"]) for r in got) == [(m, c, r, 80) for m in ("kernel_machine", "linear_machine") for c in (0.1, 1.0) for r in (0, 1)]
