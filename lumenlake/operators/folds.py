"""Grouped, stratified folds.

Groups are first added up to one row of class counts each.  Groups with the same
counts (their signature) are interchangeable, so ``stratified_folds`` deals signatures
with multiplicities on the driver -- their number does not follow that of the groups --
and the members of a signature by the order of their hash, in the cluster.
``hash_folds`` deals by majority class alone.  Folds are a table keyed by group, never
positions of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits of a hash that cut a signature's members into ranges that are numbered apart.
RANGE_DIGITS = 3


def class_counts(frame: DataFrame, group: str, target: str) -> DataFrame:
    """group, negatives, positives."""
    return frame.groupBy(group).agg(F.count_if(F.col(target) == 0).alias("negatives"), F.count_if(F.col(target) == 1).alias("positives"))


def deal(counts: np.ndarray, n_folds: int, seed: int) -> np.ndarray:
    """A fold for each group (rows of class counts): groups of most uneven counts first, each to the fold that leaves class shares most even, then to the smallest."""
    order = np.random.default_rng(seed).permutation(len(counts))
    order = order[np.argsort(-counts[order].std(axis=1), kind="stable")]
    total = np.maximum(counts.sum(0), 1)
    held = np.zeros((n_folds, counts.shape[1]))
    out = np.empty(len(counts), np.int64)
    for g in order:
        spread = []
        for f in range(n_folds):
            held[f] += counts[g]
            spread.append((round(float((held / total).std(axis=0).mean()), 12), float(held[f].sum()), f))
            held[f] -= counts[g]
        out[g] = min(spread)[2]
        held[out[g]] += counts[g]
    return out


def deal_signatures(counts: np.ndarray, members: np.ndarray, n_folds: int, seed: int) -> tuple[np.ndarray, list[list[int]]]:
    """Folds of signatures (rows of class counts) with numbers of members: of each, an equal share for every fold, and the folds of the rest.

    Signatures of most uneven counts first; a member of the rest goes to the fold that
    leaves class shares most even, then to the smallest, as ``deal`` does with groups.
    """
    order = np.random.default_rng(seed).permutation(len(counts))
    order = order[np.argsort(-counts[order].std(axis=1), kind="stable")]
    total = np.maximum((counts * members[:, None]).sum(0), 1)
    held = np.zeros((n_folds, counts.shape[1]))
    share, rest = members // n_folds, [[] for _ in counts]
    for g in order:
        held += counts[g] * share[g]
        for _ in range(int(members[g] % n_folds)):
            spread = []
            for f in range(n_folds):
                held[f] += counts[g]
                spread.append((f in rest[g], round(float((held / total).std(axis=0).mean()), 12), float(held[f].sum()), f))
                held[f] -= counts[g]
            rest[g].append(min(spread)[3])
            held[rest[g][-1]] += counts[g]
    return share, rest


def dealt(groups: DataFrame, keys: Sequence[str], group: str, n_folds: int, seed: int, attempts: int = 200) -> DataFrame:
    """keys, group, fold, seed for ``groups`` (keys, group, negatives, positives): every key's groups are dealt on their own.

    A key's seed is the first from ``seed`` on whose folds leave both classes in each
    training and test part; RuntimeError if none of ``attempts`` does.  Signatures
    and keys reach the driver; members are numbered within ranges of their hash.
    """
    spark = groups.sparkSession
    signature = [*keys, "negatives", "positives"]
    rows = groups.groupBy(*signature).agg(F.count(F.lit(1)).alias("members")).orderBy(*signature).collect()
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault(tuple(r[k] for k in keys), []).append(r)
    plan = []
    for key, own in by.items():
        counts = np.array([(r["negatives"], r["positives"]) for r in own], np.float64)
        members = np.array([r["members"] for r in own])
        for used in range(seed, seed + attempts):
            share, rest = deal_signatures(counts, members, n_folds, used)
            test = np.array([(counts * (share + [f in x for x in rest])[:, None]).sum(0) for f in range(n_folds)])
            if (test > 0).all() and ((counts * members[:, None]).sum(0) - test > 0).all():
                break
        else:
            raise RuntimeError(f"no {n_folds} folds with both classes in {attempts} attempts" + (f" for {key}" if keys else ""))
        plan += [(*key, int(r["negatives"]), int(r["positives"]), int(s), x, used) for r, s, x in zip(own, share, rest, strict=True)]
    fields = [*[groups.schema[k] for k in keys], T.StructField("negatives", T.LongType()), T.StructField("positives", T.LongType()), T.StructField("_share", T.LongType()), T.StructField("_rest", T.ArrayType(T.IntegerType())), T.StructField("seed", T.LongType())]
    table = spark.createDataFrame(plan, T.StructType(fields))
    digest = F.md5(F.concat_ws("|", F.col("seed").cast("string"), *[F.col(k).cast("string") for k in keys], F.col(group).cast("string")).cast("binary"))
    members = groups.join(table, signature).withColumn("_h", digest).withColumn("_r", F.substring("_h", 1, RANGE_DIGITS))
    sizes = members.groupBy(*signature, "_r").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*signature).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*signature, "_r", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy(*signature, "_r").orderBy("_h", group)) - 1
    numbered = members.join(sizes, [*signature, "_r"]).withColumn("_place", place)
    regular = F.col("_share") * n_folds
    fold = F.when(F.col("_place") < regular, (F.col("_place") % n_folds).cast("int")).otherwise(F.get("_rest", (F.col("_place") - regular).cast("int")))
    return numbered.select(*keys, group, fold.alias("fold"), "seed")


def stratified_folds(frame: DataFrame, group: str, target: str, n_folds: int, seed: int, attempts: int = 200) -> DataFrame:
    """group, fold, seed: the first seed from ``seed`` on whose folds leave both classes in each training and test part.

    RuntimeError if none of ``attempts`` seeds does.
    """
    return dealt(class_counts(frame.where(F.col(group).isNotNull()), group, target), [], group, n_folds, seed, attempts)


def repeated_folds(frame: DataFrame, group: str, target: str, n_folds: int, repeats: int, seed: int, inner: int = 0) -> DataFrame:
    """group, slots: the fold of each repeat; with ``inner``, then the inner fold in each (repeat, held fold), -1 for the held groups.

    All repeats are dealt together, and then all inner parts together.
    """
    counts = class_counts(frame.where(F.col(group).isNotNull()), group, target)
    spark = frame.sparkSession
    turns = spark.range(repeats).select(F.col("id").cast("int").alias("repeat"))
    outer = dealt(counts.crossJoin(F.broadcast(turns)), ["repeat"], group, n_folds, seed).select("repeat", group, "fold")
    entries = outer.select(group, F.col("repeat").alias("_slot"), "fold")
    if inner:
        outer = outer.checkpoint()
        held = spark.range(n_folds).select(F.col("id").cast("int").alias("held"))
        training = outer.crossJoin(F.broadcast(held)).where("fold <> held").join(counts, group)
        inside = dealt(training.drop("fold"), ["repeat", "held"], group, inner, seed + 1)
        slot = (F.lit(repeats) + F.col("repeat") * n_folds + F.col("held")).cast("int")
        entries = outer.select(group, F.col("repeat").alias("_slot"), "fold").unionByName(inside.select(group, slot.alias("_slot"), "fold"))
    slots = repeats * (1 + (n_folds if inner else 0))
    found = entries.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "fold"))).alias("_m"))
    return found.select(group, F.array(*[F.coalesce(F.element_at("_m", F.lit(i)), F.lit(-1)) for i in range(slots)]).alias("slots"))


def hash_folds(frame: DataFrame, group: str, target: str, n_folds: int, seed: str) -> DataFrame:
    """group, fold: within each majority class, groups are dealt by the order of their hash in turn.

    Deals in the cluster: the hash is cut into 4096 ranges, ranges are counted and
    added up, and groups are numbered inside a range only.
    """
    counts = class_counts(frame, group, target).withColumn("_c", (F.col("positives") > F.col("negatives")).cast("int"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")).cast("binary"))
    rows = counts.withColumn("_h", digest).withColumn("_r", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_c", "_r").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_c", "_r", ahead.alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_c", "_r").orderBy("_h", group))
    return rows.join(F.broadcast(sizes), ["_c", "_r"]).select(group, ((F.col("_ahead") + place - 1) % n_folds).cast("int").alias("fold"))


def fold_audit(frame: DataFrame, folds: DataFrame, group: str, target: str) -> DataFrame:
    """fold, rows, patients, benign, malignant and how many of its groups another fold has as well (leaks)."""
    rows = frame.join(folds.select(group, "fold"), group)
    leaks = folds.groupBy(group).agg(F.count_distinct("fold").alias("_f")).where("_f > 1").select(group, F.lit(1).alias("_leak"))
    rows = rows.join(leaks, group, "left")
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("patients"), F.count_if(F.col(target) == 0).alias("benign"), F.count_if(F.col(target) == 1).alias("malignant"), F.count_distinct(F.when(F.col("_leak") == 1, F.col(group))).alias("leaks"))


def group_split(frame: DataFrame, group: str, cells: list[str], share: float, seed: int, attempts: int = 100) -> DataFrame:
    """group, part (train or validation): a share of the groups by hash, the first seed whose both parts hold every cell of ``cells``.

    RuntimeError if none of ``attempts`` seeds does.
    """
    base = frame.select(group, *cells).distinct()
    need = base.select(*cells).distinct().count()
    for used in range(seed, seed + attempts):
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(used)), F.col(group).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)
        parts = base.withColumn("part", F.when(draw < share, "validation").otherwise("train"))
        seen = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count_distinct(*cells).alias("n")).collect()}
        if seen.get("train") == need and seen.get("validation") == need:
            return parts.select(group, "part").distinct()
    raise RuntimeError(f"no split holds every cell in {attempts} attempts")
