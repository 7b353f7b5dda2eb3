"""Locked evaluation: six methods tuned on source datasets alone, fitted, and scored on others, as stages of a runner.

A method goes through the same four steps -- choose its C by repeated folds of the
source, take the threshold of its out-of-fold scores, fit on the whole source, score
the targets -- whatever its model is.  Nothing of a target enters the first three.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import batched, folds, kernels, metrics, relational, selection
from lumenlake.operators.batched import Fit, Held
from lumenlake.plans.runner import Runner

RATES = ("balanced_accuracy", "sensitivity", "specificity", "f1", "mcc")
METHODS = ("hand", "embedding", "fusion", "linear_machine", "kernel_machine", "mean_fusion")


@dataclass(frozen=True)
class Protocol:
    """What a locked evaluation fixes before it sees a target."""

    hand: Sequence[str]
    embedded: Sequence[str]
    k: int = 32
    cs: Sequence[float] = selection.C_GRID
    repeats: int = 5
    n_folds: int = 4
    seed: int = 20260717
    landmarks: int = kernels.LANDMARKS
    machines: Mapping[str, float | str | None] = field(default_factory=lambda: {"linear_machine": None, "kernel_machine": "scale"})

    def designs(self) -> dict[str, selection.Design]:
        return {"hand": selection.Design(tuple(self.hand)), "embedding": selection.Design(embedded=tuple(self.embedded), k=self.k), "fusion": selection.Design(tuple(self.hand), tuple(self.embedded), self.k)}


def out_of_fold(source: DataFrame, protocol: Protocol) -> DataFrame:
    """method, c, repeat, image, patient_id, target, score of the five single methods on a source."""
    columns = [*protocol.hand, *protocol.embedded]
    slots = folds.repeated_folds(source, "patient_id", "target", protocol.n_folds, protocol.repeats, protocol.seed)
    scores = selection.out_of_fold(source, slots, protocol.repeats, protocol.n_folds, ["image"], columns, "target", "patient_id", protocol.cs, protocol.designs())
    out = scores.select(F.col("subset").alias("method"), "c", "repeat", "image", "patient_id", "target", F.col("probability").alias("score"))
    for method, gamma in protocol.machines.items():
        one = selection.machine_scores(source, slots, protocol.n_folds, ["image"], protocol.hand, "target", "patient_id", protocol.cs, (gamma,), protocol.landmarks, protocol.repeats)
        out = out.unionByName(one.select(F.lit(method).alias("method"), "c", "repeat", "image", "patient_id", "target", F.col("probability").alias("score")))
    return out


def chosen(scores: DataFrame) -> DataFrame:
    """method, c, auc: the C of the greatest mean group-balanced AUC over repeats, ties to the smaller."""
    weighted = relational.share_weight(scores, ["method", "c", "repeat", "patient_id"])
    each = metrics.auc(weighted, ["method", "c", "repeat"], "target", "score", "weight").groupBy("method", "c").agg(F.avg("auc").alias("auc"))
    best = each.groupBy("method").agg(F.max_by(F.struct("c", "auc"), F.struct(F.round("auc", 12), -F.col("c"))).alias("b"))
    return best.select("method", "b.c", "b.auc")


def scaled(scores: DataFrame, choice: DataFrame, protocol: Protocol) -> DataFrame:
    """method, slope, constant, threshold: margins become probabilities by a logistic model of the out-of-fold ones; the threshold is Youden's, the mean over both for the fusion."""
    own = scores.join(choice.select("method", "c"), ["method", "c"]).where("repeat = 0").checkpoint()
    rows = []
    for r in choice.collect():
        method, slope, constant = r["method"], 1.0, 0.0
        mine = own.where(F.col("method") == method)
        if method in protocol.machines:
            study = batched.prepare(mine, ["image"], ["score"], "target", F.array(F.lit(0)))
            study.parts = [Held(0, (0,))]
            flat = batched.fit(study, [Fit(0, 1e3, (0,))]).flat[0]
            mean, deviation = study.scale["score"]
            slope, constant = float(flat[0] / deviation), float(flat[1] - flat[0] * mean / deviation)
            mine = mine.withColumn("score", 1 / (1 + F.exp(-(F.col("score") * slope + constant))))
        at = metrics.youden(relational.share_weight(mine, ["patient_id"]), [], "target", "score", "weight").first()["threshold"]
        rows.append((method, slope, constant, float(at)))
    parts = {m: t for m, _, _, t in rows}
    rows.append(("mean_fusion", 1.0, 0.0, (parts["hand"] + parts["embedding"]) / 2))
    return scores.sparkSession.createDataFrame(rows, "method string, slope double, constant double, threshold double")


def scored(frame: DataFrame, choice: DataFrame, scale: DataFrame, source: str, targets: Sequence[str], protocol: Protocol) -> DataFrame:
    """method, dataset, image, patient_id, target, probability on the targets, of models of the whole source."""
    c = {r["method"]: r["c"] for r in choice.collect()}
    columns, keys = [*protocol.hand, *protocol.embedded], ["image", "patient_id"]
    runs = {source: ([source], list(targets))}
    parts = []
    for name, design in protocol.designs().items():
        one, _ = selection.by_dataset(frame, "dataset", keys, columns, "target", runs, c[name], {name: design})
        parts.append(one.select(F.col("subset").alias("method"), "dataset", *keys, "target", F.col("probability").alias("score")))
    names = [source, *targets]
    code = F.array_position(F.array(*map(F.lit, names)), F.col("dataset")) - 1
    study = batched.prepare(frame.where(F.col("dataset").isin(names)), [*keys, "dataset"], protocol.hand, "target", F.array(code.cast("int")))
    study.parts = [Held(0, (0,)), Held(0, tuple(range(1, len(names))))]
    for name, gamma in protocol.machines.items():
        if gamma is None:
            one = batched.predict(study, batched.fit(study, [Fit(0, c[name], tuple(range(len(protocol.hand))), loss="hinge")]), [(0, 1)])
        else:
            one = kernels.predict(study, kernels.fit(study, [kernels.Machine(0, c[name], gamma)], protocol.landmarks), [(0, 1)])
        parts.append(one.select(F.lit(name).alias("method"), "dataset", *keys, "target", F.col("probability").alias("score")))
    every = reduce(DataFrame.unionByName, parts).join(F.broadcast(scale.drop("threshold")), "method")
    margin = F.col("method").isin(list(protocol.machines))
    single = every.select("method", "dataset", *keys, "target", F.when(margin, 1 / (1 + F.exp(-(F.col("score") * F.col("slope") + F.col("constant"))))).otherwise(F.col("score")).alias("probability"))
    fused = single.where(F.col("method").isin("hand", "embedding")).groupBy("dataset", *keys, "target").agg(F.avg("probability").alias("probability"))
    return single.unionByName(fused.select(F.lit("mean_fusion").alias("method"), "dataset", *keys, "target", "probability"))


def measured(scores: DataFrame, scale: DataFrame) -> DataFrame:
    """method, dataset, metric, value: the thirteen metrics of every method on every target at the source's threshold."""
    keys = ["method", "dataset"]
    rows = relational.share_weight(scores, [*keys, "patient_id"], "w").join(F.broadcast(scale.select("method", "threshold")), "method").checkpoint()
    w = F.col("w")
    lines = metrics.calibrations(rows, keys, "target", "probability", w)
    table = scores.sparkSession.createDataFrame([(*k, float(a), float(b)) for k, (a, b) in lines.items()], "method string, dataset string, calibration_intercept double, calibration_slope double")
    rates = metrics.rates(metrics.confusion(rows, keys, "target", F.col("probability") >= F.col("threshold"), "w")).select(*keys, *RATES)
    parts = [
        metrics.auc(rows, keys, "target", "probability", "w").withColumnRenamed("auc", "group_balanced_roc_auc"),
        metrics.auc(rows, keys, "target", "probability").withColumnRenamed("auc", "image_roc_auc"),
        metrics.average_precision(rows, keys, "target", "probability", "w"),
        rates,
        rows.groupBy(*keys).agg(metrics.brier("target", "probability", w).alias("brier"), F.max("threshold").alias("threshold")),
        table,
        metrics.ece(metrics.width_bins(rows, keys, "target", "probability", w), keys).withColumnRenamed("ece", "ece_10"),
    ]
    wide = reduce(lambda a, b: a.join(b, keys), parts)
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.metric", "m.value")


def evaluate(runner: Runner, frame: DataFrame, source: str, targets: Sequence[str], protocol: Protocol) -> DataFrame:
    """``measured`` of ``frame`` (image, patient_id, dataset, target, columns), stage by stage: what the runner has committed is not run again."""
    fixed = {"hand": list(protocol.hand), "embedded": list(protocol.embedded), "k": protocol.k, "cs": list(protocol.cs), "repeats": protocol.repeats, "folds": protocol.n_folds, "seed": protocol.seed, "landmarks": protocol.landmarks}
    names = [source, *targets]
    cohort = runner.run("cohort", lambda datasets: frame.where(F.col("dataset").isin(datasets)), datasets=names)
    own = runner.run("out_of_fold", lambda rows, **_: out_of_fold(rows.where(F.col("dataset") == source), protocol), {"rows": cohort}, source=source, **fixed)
    choice = runner.run("chosen", lambda scores: chosen(scores), {"scores": own})
    scale = runner.run("scaled", lambda scores, choice: scaled(scores, choice, protocol), {"scores": own, "choice": choice})
    scores = runner.run("scored", lambda rows, choice, scale, **_: scored(rows, choice, scale, source, targets, protocol), {"rows": cohort, "choice": choice, "scale": scale}, source=source, **fixed)
    return runner.run("measured", lambda scores, scale: measured(scores, scale), {"scores": scores, "scale": scale}).table
