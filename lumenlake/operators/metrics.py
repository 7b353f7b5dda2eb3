"""Weighted metrics of binary scores as grouped aggregates.

All take a table with a target (0/1), a score and a weight, and any number of key
columns that separate cohorts; none gathers a cohort in a task or on the driver.
Rank metrics first add up weights of equal scores and then use running sums over
stretches of the score (``ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.ordered import sums_before

EPS = 2.220446049250313e-16
#: Thresholds of the decision curve: 0.10 to 0.80 by 0.01.
THRESHOLDS = tuple(round(0.10 + 0.01 * i, 2) for i in range(71))


def score_table(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: str | None) -> DataFrame:
    """keys, score, wp, wn: the weight of positives and of negatives at each score; null scores and targets are dropped."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = frame.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.when(F.col(target) == 1, w).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col(target) == 0, w).otherwise(0.0)).alias("wn"))


def auc(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: str | None = None) -> DataFrame:
    """keys, auc: the weighted share of (positive, negative) pairs in order, ties half; null for one class."""
    table = sums_before(score_table(frame, keys, target, score, weight), keys, "score", ["wn"])
    won = F.sum(F.col("wp") * (F.col("wn_before") + F.col("wn") / 2))
    pairs = F.sum("wp") * F.sum("wn")
    return table.groupBy(*keys).agg(F.when(pairs > 0, won / pairs).alias("auc"))


def average_precision(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: str | None = None) -> DataFrame:
    """keys, average_precision: precision at each distinct score, weighted by the recall gained there."""
    table = sums_before(score_table(frame, keys, target, score, weight), keys, "score", ["wp", "wn"], descending=True)
    tp = F.col("wp_before") + F.col("wp")
    taken = tp + F.col("wn_before") + F.col("wn")
    return table.groupBy(*keys).agg((F.sum(F.when(taken > 0, F.col("wp") * tp / taken)) / F.sum("wp")).alias("average_precision"))


def youden(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: str | None = None) -> DataFrame:
    """keys, threshold: the score whose true less false positive rate is greatest, the highest of equal ones, within 0..1; 0.5 for one class."""
    table = sums_before(score_table(frame, keys, target, score, weight), keys, "score", ["wp", "wn"], descending=True)
    totals = table.groupBy(*keys).agg(F.sum("wp").alias("p"), F.sum("wn").alias("n"))
    rows = table.join(totals, list(keys)) if keys else table.crossJoin(F.broadcast(totals))
    gain = (F.col("wp_before") + F.col("wp")) / F.col("p") - (F.col("wn_before") + F.col("wn")) / F.col("n")
    rows = rows.withColumn("gain", F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(gain, 12)))
    best = F.max_by("score", F.struct("gain", "score"))
    return rows.groupBy(*keys).agg(F.when(F.max("gain").isNull(), F.lit(0.5)).otherwise(F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0))).alias("threshold"))


def confusion(frame: DataFrame, keys: Sequence[str], target: str, positive: Column, weight: str | None = None) -> DataFrame:
    """keys, tp, fp, fn, tn by weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    said = F.coalesce(positive, F.lit(False))
    cell = lambda t, s: F.sum(F.when((F.col(target) == t) & (said == F.lit(s)), w).otherwise(0.0))
    return frame.groupBy(*keys).agg(cell(1, True).alias("tp"), cell(0, True).alias("fp"), cell(1, False).alias("fn"), cell(0, False).alias("tn"))


def rates(table: DataFrame) -> DataFrame:
    """``confusion`` with sensitivity, specificity, balanced accuracy, F1 and MCC (0 where undefined)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sensitivity = tp / F.greatest(tp + fn, F.lit(EPS))
    specificity = tn / F.greatest(tn + fp, F.lit(EPS))
    both = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return table.withColumns({"sensitivity": sensitivity, "specificity": specificity, "balanced_accuracy": (sensitivity + specificity) / 2, "f1": f1, "mcc": F.when(both > 0, (tp * tn - fp * fn) / both).otherwise(0.0)})


def brier(target: str, score: str, weight: Column) -> Column:
    return F.sum(weight * (F.col(score) - F.col(target)) ** 2) / F.sum(weight)


def log_loss(target: str, score: str, weight: Column, clip: float = 1e-12) -> Column:
    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    return F.sum(weight * -(F.col(target) * F.log(p) + (1 - F.col(target)) * F.log(1 - p))) / F.sum(weight)


def width_bins(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: Column, n: int = 10) -> DataFrame:
    """keys, bin (0..n-1), weight, observed, predicted over bins of equal width; the last one is closed."""
    edges = [i / n for i in range(1, n)]
    b = sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = frame.where((F.col(score) >= 0) & (F.col(score) <= 1))
    return rows.groupBy(*keys, b.cast("int").alias("bin")).agg(F.sum(weight).alias("weight"), (F.sum(weight * F.col(target)) / F.sum(weight)).alias("observed"), (F.sum(weight * F.col(score)) / F.sum(weight)).alias("predicted"))


def ece(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ece: the weighted mean gap between predicted and observed over bins."""
    return bins.groupBy(*keys).agg((F.sum(F.col("weight") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("weight")).alias("ece"))


def mass_bins(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: str, order: Sequence[str], n: int = 10) -> DataFrame:
    """keys, bin (1..n), n_images, weight, mean_prediction, observed_fraction, absolute_gap over bins of equal weight.

    A row lies in the bin of its middle in the running weight, by (score, order).
    Running weights are added up per score and, within a score, by a window.
    """
    per_score = frame.groupBy(*keys, score).agg(F.sum(weight).alias("_w"))
    before = sums_before(per_score, keys, score, ["_w"]).select(*keys, score, "_w_before")
    totals = per_score.groupBy(*keys).agg(F.sum("_w").alias("_all"))
    from pyspark.sql import Window

    own = Window.partitionBy(*keys, score).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = frame.join(before, [*keys, score])
    rows = rows.join(totals, list(keys)) if keys else rows.crossJoin(F.broadcast(totals))
    middle = F.col("_w_before") + F.sum(weight).over(own) - F.col(weight) / 2
    rows = rows.withColumn("bin", (F.least(F.floor(F.round(n * middle / F.col("_all"), 9)), F.lit(n - 1)) + 1).cast("int"))
    w = F.col(weight)
    mean = F.sum(w * F.col(score)) / F.sum(w)
    seen = F.sum(w * F.col(target)) / F.sum(w)
    return rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n_images"), F.sum(w).alias("weight"), mean.alias("mean_prediction"), seen.alias("observed_fraction"), F.abs(mean - seen).alias("absolute_gap"))


def decision_curve(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: Column, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """keys, threshold, net_benefit, treat_all: one pass with a sum for each threshold, then turned to rows."""
    odds = {t: t / (1 - t) for t in thresholds}
    sums = [F.sum(F.when(F.col(score) >= t, weight * F.when(F.col(target) == 1, F.lit(1.0)).otherwise(F.lit(-odds[t]))).otherwise(0.0)).alias(f"_{i}") for i, t in enumerate(thresholds)]
    rows = frame.groupBy(*keys).agg(F.sum(weight).alias("_all"), F.sum(weight * F.col(target)).alias("_pos"), *sums)
    curve = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"_{i}") / F.col("_all")).alias("net_benefit"), ((F.col("_pos") - (F.col("_all") - F.col("_pos")) * odds[t]) / F.col("_all")).alias("treat_all")) for i, t in enumerate(thresholds)])
    return rows.select(*keys, F.explode(curve).alias("c")).select(*keys, "c.threshold", "c.net_benefit", "c.treat_all")


def calibrations(frame: DataFrame, keys: Sequence[str], target: str, score: str, weight: Column, ridge: float = 1e-6, clip: float = 1e-6, steps: int = 25) -> dict[tuple, tuple[float, float]]:
    """Intercept and slope of the target on the score's logit for each key (a study's methods and datasets), by Newton steps; a step is one aggregate of five sums a key."""
    import math

    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    rows = frame.select(*keys, F.col(target).cast("double").alias("_y"), F.log(p / (1 - p)).alias("_x"), weight.cast("double").alias("_w"))
    found: dict[tuple, tuple[float, float]] = {}
    open_: set[tuple] | None = None
    for _ in range(steps):
        a, b = F.lit(0.0), F.lit(1.0)
        if keys:
            for key, (x, y) in found.items():
                own = F.lit(True)
                for k, v in zip(keys, key, strict=True):
                    own = own & F.col(k).eqNullSafe(F.lit(v))
                a, b = F.when(own, F.lit(x)).otherwise(a), F.when(own, F.lit(y)).otherwise(b)
        elif found:
            a, b = map(F.lit, found[()])
        fitted = 1 / (1 + F.exp(-(a + b * F.col("_x"))))
        r, h = F.col("_w") * (F.col("_y") - fitted), F.col("_w") * fitted * (1 - fitted)
        sums = rows.groupBy(*keys).agg(F.sum(r).alias("g0"), F.sum(r * F.col("_x")).alias("g1"), F.sum(h).alias("h0"), F.sum(h * F.col("_x")).alias("h1"), F.sum(h * F.col("_x") ** 2).alias("h2")).collect()
        if open_ is None:
            open_ = {tuple(s[k] for k in keys) for s in sums}
            found = {key: (0.0, 1.0) for key in open_}
        for s in sums:
            key = tuple(s[k] for k in keys)
            if key not in open_:
                continue
            if s["g0"] is None:
                open_.discard(key)
                continue
            one, two = found[key]
            g1, h2 = s["g1"] - ridge * two, s["h2"] + ridge
            det = s["h0"] * h2 - s["h1"] ** 2
            if not det > 0:
                open_.discard(key)
                continue
            da, db = (h2 * s["g0"] - s["h1"] * g1) / det, (s["h0"] * g1 - s["h1"] * s["g0"]) / det
            size = max(abs(da), abs(db), 1e-300)
            scale = min(1.0, 5.0 / size)
            found[key] = (one + scale * da, two + scale * db)
            if size < 1e-10 * (1 + math.hypot(*found[key])):
                open_.discard(key)
        if not open_:
            break
    return found


def calibration(frame: DataFrame, target: str, score: str, weight: Column, ridge: float = 1e-6, clip: float = 1e-6, steps: int = 25) -> tuple[float, float]:
    """``calibrations`` of one cohort; (0, 1) without rows."""
    return calibrations(frame, [], target, score, weight, ridge, clip, steps).get((), (0.0, 1.0))


def benjamini_hochberg(frame: DataFrame, keys: Sequence[str], p: str, order: Sequence[str]) -> DataFrame:
    """``frame`` with q: the adjusted p-values of each key's family of tests (families are small)."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys)
    ranked = frame.withColumn("_rank", F.row_number().over(by.orderBy(p, *order))).withColumn("_m", F.count(F.lit(1)).over(by))
    raw = F.col(p) * F.col("_m") / F.col("_rank")
    least = F.min(raw).over(by.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("q", F.least(least, F.lit(1.0))).drop("_rank", "_m")
