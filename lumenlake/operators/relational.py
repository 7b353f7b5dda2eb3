"""Relational building blocks: guards, weights, joins that must be one to one, cascades, ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ scalars


def truthy(column: str | Column) -> Column:
    """Tolerant boolean: true, 1 and yes in any case; null is false."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def first_reason(rules: Sequence[tuple[str, Column]], none: str = "") -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules], F.lit(none))


def label_from_prefix(name: Column, labels: Sequence[str], other: str = "unknown") -> Column:
    """The label whose ``<label>_`` begins a file name."""
    return F.coalesce(*[F.when(F.lower(name).startswith(f"{label}_"), F.lit(label)) for label in labels], F.lit(other))


def hash_seed(*parts: Column) -> Column:
    """The first 8 bytes, little-endian, of the SHA-256 of the parts joined by a bar, modulo 2**32 - 1."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)
    value = F.lit(0).cast("decimal(38,0)")
    for i in range(8):
        byte = F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("decimal(38,0)")
        value = value + byte * F.lit(256**i).cast("decimal(20,0)")
    return (value % F.lit(2**32 - 1).cast("decimal(38,0)")).cast("long")


def wrapped_angle(angle: Column) -> Column:
    """An angle folded to (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def family(column: Column, prefixes: Mapping[str, str]) -> Column:
    """The family of a feature name by its prefix; any other name is an error."""
    cases = [F.when(column.startswith(p), F.lit(name)) for p, name in prefixes.items()]
    return F.coalesce(*cases, F.raise_error(F.concat(F.lit("no family has the column "), column)).cast("string"))


# ------------------------------------------------------------------ guards


def require_unique(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``frame``, failing when it is run if a key occurs twice.

    The check is a count over the key beside the rows, so the guard runs in the
    same job and a downstream join on the key reuses its partitioning.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    text = F.concat(F.lit("key is not unique: "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    checked = frame.withColumn("_n", F.when(n > 1, F.raise_error(text).cast("long")).otherwise(n))
    return checked.where("_n = 1").drop("_n")


def require_finite(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``frame``, failing when it is run if one of the columns is null, NaN or infinite."""
    out = frame
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
        out = out.withColumn(c, F.when(bad, F.raise_error(F.lit(f"not finite: {c}")).cast(frame.schema[c].dataType)).otherwise(F.col(c)))
    return out


def nonfinite_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: of each column how many values are null, NaN or infinite."""
    bad = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns}
    return frame.agg(*[F.count_if(b).alias(c) for c, b in bad.items()])


def missing_columns(frame: DataFrame, needed: Sequence[str]) -> list[str]:
    """The needed columns that a table lacks, sorted."""
    return sorted(set(needed) - set(frame.columns))


# ------------------------------------------------------------------ joins


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join whose keys must be unique on both sides."""
    return require_unique(left, keys).join(require_unique(right, keys), list(keys), how)


def align(frames: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Tables (keys, value) side by side, one column a table, of the keys that all have.

    One shuffle for any number of tables: they are stacked and grouped by key.  A
    key that a table has twice fails.
    """
    stacked = reduce(DataFrame.unionByName, [f.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(name).alias("_of")) for name, f in frames.items()])
    sides = []
    for name in frames:
        own = F.when(F.col("_of") == name, F.col("_v"))
        n = F.count_if(F.col("_of") == name)
        sides.append(F.when(n > 1, F.raise_error(F.lit(f"key occurs twice in {name}")).cast("double")).otherwise(F.max(own)).alias(name))
    return stacked.groupBy(*keys).agg(*sides, F.count_distinct("_of").alias("_n")).where(F.col("_n") == len(frames)).drop("_n")


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks: (key, side that has it)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("found_in", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("found_in", F.lit("right")))


def misaligned(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (with repeats) that only one of two tables has."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("found_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("found_in", F.lit("right")))


# ------------------------------------------------------------------ weights


def share_weight(frame: DataFrame, keys: Sequence[str], name: str = "weight") -> DataFrame:
    """One over the size of the row's group, so that groups weigh alike."""
    return frame.withColumn(name, F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def normalised_weight(frame: DataFrame, group: str, name: str = "weight") -> DataFrame:
    """Group-balanced weights that add up to the number of groups.

    The weights of a group add up to 1 already, and so do all to the number of
    groups; the factor is kept for groups that are null.
    """
    rows = share_weight(frame, [group], name)
    totals = rows.agg(F.count_distinct(group).alias("_g"), F.sum(name).alias("_w"))
    return rows.crossJoin(F.broadcast(totals)).withColumn(name, F.col(name) * F.col("_g") / F.col("_w")).drop("_g", "_w")


def stratum_weight(frame: DataFrame, strata: Sequence[str], group: str, name: str = "weight") -> DataFrame:
    """Strata weigh alike, groups alike within a stratum, rows alike within a group of it; the mean weight is 1."""
    sizes = frame.groupBy(*strata, group).agg(F.count(F.lit(1)).alias("_rows"))
    groups = sizes.groupBy(*strata).agg(F.count(F.lit(1)).alias("_groups"), F.sum("_rows").alias("_all"))
    totals = groups.agg(F.sum("_all").alias("_n"), F.count(F.lit(1)).alias("_strata"))
    factor = sizes.join(groups, list(strata)).crossJoin(F.broadcast(totals))
    factor = factor.select(*strata, group, (F.col("_n") / (F.col("_strata") * F.col("_groups") * F.col("_rows"))).alias(name))
    return frame.join(factor, [*strata, group])


def sampler_weight(frame: DataFrame, strata: Sequence[str], group: str, name: str = "weight") -> DataFrame:
    """1 / (rows of the group over all strata * groups of the stratum), with mean 1."""
    group_rows = frame.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    groups = frame.groupBy(*strata).agg(F.count_distinct(group).alias("_groups"))
    raw = frame.join(group_rows, group).join(groups, list(strata)).withColumn(name, 1.0 / F.greatest(F.col("_rows") * F.col("_groups"), F.lit(1)))
    mean = raw.agg(F.avg(name).alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn(name, F.col(name) / F.col("_mean")).drop("_rows", "_groups", "_mean")


def stratum_totals(frame: DataFrame, strata: Sequence[str], name: str = "weight") -> DataFrame:
    """The audit of ``stratum_weight``: each stratum's total, and whether it equals the first one to 1e-8."""
    totals = frame.groupBy(*strata).agg(F.sum(name).alias("total"))
    ends = totals.agg(F.min("total").alias("_low"), F.max("total").alias("_high"))
    return totals.crossJoin(F.broadcast(ends)).withColumn("balanced", F.col("_high") - F.col("_low") < 1e-8 * F.col("_high")).drop("_low", "_high")


# ------------------------------------------------------------------ groups


def collapse(frame: DataFrame, group: str, label: str, target: str, score: str, how: str = "mean") -> DataFrame:
    """One row a group: label, target, rows and mean or median score; a group with two targets is an error."""
    value = F.avg(score) if how == "mean" else F.percentile(score, F.lit(0.5))
    mixed = F.min(target) != F.max(target)
    one = F.when(mixed, F.raise_error(F.concat(F.lit("labels differ in group "), F.col(group).cast("string"))).cast(frame.schema[target].dataType)).otherwise(F.min(target))
    return frame.groupBy(group).agg(F.min(label).alias(label), one.alias(target), F.count(F.lit(1)).alias("n_rows"), value.alias(score))


def wide(frame: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str, prefix: str = "probability_") -> DataFrame:
    """Long to wide with known column names: the mean value of each name."""
    return frame.groupBy(*keys).pivot(name, list(names)).agg(F.avg(value)).select(*keys, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])


def best_by(frame: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order, ties broken by the order's later columns."""
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def repeated(frame: DataFrame, digest: str, member: str, separator: str = "|") -> DataFrame:
    """Digests that more than one row has: digest, n, members in order."""
    out = frame.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.col(member).cast("string"))), separator).alias("members"))
    return out.where("n > 1")


def shared_between(frame: DataFrame, digest: str, dataset: str, member: str) -> DataFrame:
    """Digests that two datasets share: digest, datasets, n, members as dataset:member."""
    name = F.concat_ws(":", F.col(dataset), F.col(member).cast("string"))
    out = frame.groupBy(digest).agg(F.array_join(F.sort_array(F.collect_set(dataset)), "|").alias("datasets"), F.count_distinct(dataset).alias("_n"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(name)), "|").alias("members"))
    return out.where("_n > 1").drop("_n")
