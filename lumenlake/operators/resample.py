"""Cluster bootstrap as a weighted aggregate.

A replicate draws whole units (patients) with replacement.  What a metric needs
of a draw is how often each unit was drawn, so a replicate is a weight on rows:
multiplicity times 1 / rows of the unit.  Draws are a table (iteration, unit, m);
all replicates are then one grouped weighted metric, with the iteration as a key.

Two sources of draws: ``hash_draws`` makes them in the cluster from hashes (any
size, the same in any engine), ``numpy_draws`` on the driver from a seeded
generator for a bounded number of units.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.operators.metrics import THRESHOLDS, auc
from lumenlake.operators.ordered import cut_points, stretch_of, text_cut_points

#: Units whose draws the driver may make.
MOST_UNITS = 100_000


def numbered(frame: DataFrame, unit: str) -> DataFrame:
    """unit, n: the distinct units numbered from 0 in the order of their text.

    No task orders all of them: they are cut into ranges at quantiles that a sketch
    of their texts finds, counted by range, and numbered within a range only.  What
    the texts begin with does not matter, nor does a stray one.
    """
    units = frame.select(unit).where(F.col(unit).isNotNull()).distinct()
    text = F.col(unit).cast("string")
    ranges = units.withColumn("_r", stretch_of(text, text_cut_points(units, unit))[0])
    sizes = ranges.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"))
    ahead = F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_r", ahead.alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(text))
    return ranges.join(sizes, "_r").select(unit, (F.col("_ahead") + place - 1).alias("n"))


def weighted_draws(frame: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """draw, key: n draws with replacement by weight, by md5 of (seed, draw), over keys (numbers, unique) in their order.

    A draw first meets a stretch of keys by the stretches' sums, then, joined by
    the stretch, the key whose interval of running weights holds it.  Rows of null
    key or without a weight above 0 are never drawn.
    """
    rows = frame.select(F.col(key), F.col(weight).cast("double").alias("_w")).where(F.col(key).isNotNull() & (F.col("_w") > 0))
    rows = rows.withColumn("_stretch", stretch_of(F.col(key), cut_points(rows, key))[0])
    sums = rows.groupBy("_stretch").agg(F.sum("_w").alias("_s"))
    ahead = F.coalesce(F.sum("_s").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select("_stretch", ahead.alias("_ahead"), F.sum("_s").over(Window.partitionBy(F.lit(1))).alias("_total"))
    sums = sums.withColumn("_end", F.coalesce(F.lead("_ahead").over(Window.orderBy("_stretch")), F.col("_total")))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    draws = frame.sparkSession.range(n).select(F.col("id").alias("draw"), u.alias("_u"))
    at = F.col("_u") * F.col("_total")
    met = sums.join(F.broadcast(draws), (at >= F.col("_ahead")) & (at < F.col("_end"))).select("_stretch", "draw", at.alias("_at"))
    own = Window.partitionBy("_stretch").orderBy(key)
    low = F.col("_ahead") + F.coalesce(F.sum("_w").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lows = rows.join(sums, "_stretch").withColumn("_low", low)
    bounds = lows.withColumn("_high", F.coalesce(F.lead("_low").over(own), F.col("_end"))).select("_stretch", key, "_low", "_high")
    return bounds.join(met, "_stretch").where((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))).select("draw", key)


def hash_draws(units: DataFrame, unit: str, iterations: int, seed: str) -> DataFrame:
    """iteration, unit, m: for each replicate as many draws as there are units, by md5 of (seed, iteration, draw) modulo their number.

    ``units`` (unit, n) is numbered from 0.  Draws are made from the numbers, so
    one row a draw goes into a grouped count and comes out as multiplicities.
    """
    spark = units.sparkSession
    total = units.agg(F.count(F.lit(1)).alias("total"))
    turns = spark.range(iterations).withColumnRenamed("id", "iteration")
    drawn = units.select(F.col("n").alias("draw")).crossJoin(F.broadcast(turns)).crossJoin(F.broadcast(total))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("iteration").cast("string"), F.col("draw").cast("string")).cast("binary"))
    picked = drawn.select("iteration", (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.col("total")).alias("n"))
    return picked.groupBy("iteration", "n").agg(F.count(F.lit(1)).alias("m")).join(units, "n").select("iteration", unit, "m")


def numpy_draws(spark: SparkSession, units: Sequence, unit: str, iterations: int, seed: int) -> DataFrame:
    """iteration, unit, m from ``numpy.random.default_rng(seed).choice`` over the units in the order given."""
    if len(units) > MOST_UNITS:
        raise ValueError(f"{len(units)} units; use hash_draws beyond {MOST_UNITS}")
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(iterations):
        picked = rng.choice(len(units), size=len(units), replace=True)
        for j, m in zip(*np.unique(picked, return_counts=True), strict=True):
            rows.append((i, units[int(j)], int(m)))
    kind = "long" if units and isinstance(units[0], int | np.integer) else "string"
    return spark.createDataFrame(rows, f"iteration long, {unit} {kind}, m long")


def replicate_auc(frame: DataFrame, draws: DataFrame, unit: str, target: str, scores: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, iteration, <score>...: the group-balanced AUC of each score in each replicate that has both classes.

    Rows of a unit are first added up by (unit, score, target), so the join with
    the draws sees a unit's distinct scores and not its rows.
    """
    by = Window.partitionBy(*keys, unit)
    rows = frame.withColumn("_w", F.lit(1.0) / F.count(F.lit(1)).over(by))
    out = None
    for s in scores:
        small = rows.groupBy(*keys, unit, target, s).agg(F.sum("_w").alias("_w"))
        drawn = small.join(draws, unit).withColumn("_w", F.col("_w") * F.col("m"))
        one = auc(drawn, [*keys, "iteration"], target, s, "_w").where("auc IS NOT NULL").withColumnRenamed("auc", s)
        out = one if out is None else out.join(one, [*keys, "iteration"])
    return out


def interval(frame: DataFrame, keys: Sequence[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """keys, mean, ci_low, ci_high, replicates, p_positive (share above 0), p_nonnegative, p_value (two-sided)."""
    v = F.col(value)
    above, below = F.avg((v >= 0).cast("double")), F.avg((v <= 0).cast("double"))
    return frame.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.percentile(v, F.lit(low)).alias("ci_low"),
        F.percentile(v, F.lit(high)).alias("ci_high"),
        F.count(v).alias("replicates"),
        F.avg((v > 0).cast("double")).alias("p_positive"),
        above.alias("p_nonnegative"),
        F.least(F.lit(1.0), 2 * F.least(above, below)).alias("p_value"),
    )


def paired_intervals(replicates: DataFrame, scores: Sequence[str], reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, score, interval of score - reference over replicates that have both."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), (F.col(s) - F.col(reference)).alias("delta")) for s in scores if s != reference]))
    return interval(replicates.select(*keys, pairs.alias("p")).select(*keys, "p.score", "p.delta"), [*keys, "score"], "delta")


def unit_table(frame: DataFrame, unit: str, target: str, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """unit, brier, tp, fp: a unit's mean squared error and its rates of true and false positives at each threshold (arrays)."""
    p, y = F.col(score), F.col(target)
    rate = lambda t, c: F.avg(((p >= t) & (y == c)).cast("double"))
    return frame.groupBy(unit).agg(F.avg((p - y) ** 2).alias("brier"), F.array(*[rate(t, 1) for t in thresholds]).alias("tp"), F.array(*[rate(t, 0) for t in thresholds]).alias("fp"))


def unit_deltas(first: DataFrame, second: DataFrame, unit: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """unit, brier_delta, net_benefit_delta of two ``unit_table``s; the net benefit is the mean over the thresholds."""
    odds = F.array(*[F.lit(t / (1 - t)) for t in thresholds])

    def summed(table: DataFrame) -> DataFrame:
        net = F.aggregate(F.zip_with(F.zip_with("tp", "fp", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), odds, lambda r, o: r["a"] - r["b"] * o), F.lit(0.0), lambda s, x: s + x) / len(thresholds)
        return table.select(unit, "brier", net.alias("net"))

    both = summed(first).join(summed(second).select(unit, F.col("brier").alias("brier2"), F.col("net").alias("net2")), unit)
    return both.select(unit, (F.col("brier") - F.col("brier2")).alias("brier_delta"), (F.col("net") - F.col("net2")).alias("net_benefit_delta"))


def utility_deltas(frame: DataFrame, unit: str, target: str, first: str, second: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """``unit_deltas`` of two scores in one grouping of four means: a row's net benefit is worked out before, since means are linear.

    A null score reaches no threshold.
    """
    y = F.col(target)
    lost = [0.0]
    for t in sorted(thresholds):
        lost.append(lost[-1] + t / (1 - t))

    def net(score: str) -> Column:
        reached = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(score) >= t))
        return F.when(y == 1, reached.cast("double")).when(y == 0, -F.element_at(F.array(*map(F.lit, lost)), reached + 1)).otherwise(0.0) / len(thresholds)

    rows = frame.select(unit, *[((F.col(c) - y) ** 2).alias(f"_b{i}") for i, c in enumerate((first, second))], *[net(c).alias(f"_n{i}") for i, c in enumerate((first, second))])
    return rows.groupBy(unit).agg((F.avg("_b0") - F.avg("_b1")).alias("brier_delta"), (F.avg("_n0") - F.avg("_n1")).alias("net_benefit_delta"))


def utility_replicates(first: DataFrame, second: DataFrame, draws: DataFrame, unit: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """iteration, brier_delta, net_benefit_delta of two ``unit_table``s: unit means over each replicate of a table of draws."""
    drawn = unit_deltas(first, second, unit, thresholds).join(draws, unit)
    mean = lambda c: F.sum(F.col("m") * F.col(c)) / F.sum("m")
    return drawn.groupBy("iteration").agg(*[mean(c).alias(c) for c in ("brier_delta", "net_benefit_delta")])
