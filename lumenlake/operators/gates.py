"""Decisions of a study as boolean expressions over its metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary_supported(table: DataFrame) -> DataFrame:
    """``table`` (dataset, auc, reference_auc, ci_low) -> supported: nowhere below the reference, and above it with confidence somewhere."""
    return table.agg((F.bool_and(F.col("auc") >= F.col("reference_auc")) & F.bool_or(F.col("ci_low") > 0)).alias("supported"))


def early_promoted(table: DataFrame, gain: float = 0.015, loss: float = -0.010, sure: float = 0.95) -> DataFrame:
    """``table`` (dataset, mean, p_positive) of paired deltas -> promoted: a gain somewhere, no loss anywhere, and one that is nearly sure."""
    return table.agg((F.bool_or(F.col("mean") >= gain) & F.bool_and(F.col("mean") >= loss) & F.bool_or(F.col("p_positive") >= sure)).alias("promoted"))


def block_claim(deltas: DataFrame, scores: DataFrame, full: str, ablated: str) -> DataFrame:
    """Whether a block's contribution is a strong claim.

    ``deltas`` (context, ablated_model, point_delta, delta_ci_low), ``scores``
    (model, auc) over left-out datasets -> external (a sure gain outside), mean_gain
    (0.01 or more on average), no_loss (nowhere below -0.01), retained.
    """
    own = deltas.where(F.col("ablated_model") == ablated)
    external = F.coalesce(F.bool_or(F.when(F.col("context") == "locked_external", F.col("delta_ci_low") > 0)), F.lit(False))
    no_loss = F.coalesce(F.bool_and(F.when(F.col("context") == "lodo", F.col("point_delta") >= -0.01)), F.lit(True))
    gain = F.avg(F.when(F.col("model") == full, F.col("auc"))) - F.avg(F.when(F.col("model") == ablated, F.col("auc")))
    both = own.agg(external.alias("external"), no_loss.alias("no_loss")).crossJoin(scores.agg((gain >= 0.01).alias("mean_gain")))
    return both.select("external", "mean_gain", "no_loss", (F.col("external") | (F.col("mean_gain") & F.col("no_loss"))).alias("retained"))
