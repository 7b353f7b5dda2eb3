"""Running sums over an order without one task that holds it.

Rows are dealt into stretches of the order at cut points from a mergeable quantile
sketch, so a stretch has about one part in ``STRETCHES`` of the rows however the
values crowd or stray; a value that has more than its share is a stretch of its own.
Sums of stretches are added up over those few hundred rows a key, and only within a
stretch is a window sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of an order, and the sketch's accuracy (its rank error is one part in this many).
STRETCHES, ACCURACY = 200, 10_000
#: Cut points that are looked at together.
CHUNK = 15


def cut_points(frame: DataFrame, value: str, stretches: int = STRETCHES) -> list:
    """Values at equal shares of the rows, rising; a value of more than one share comes up more than once.  Nulls do not count.

    One pass; a task's sketch and what the driver gets have a bounded size.
    """
    shares = [i / stretches for i in range(1, stretches)]
    if not shares:
        return []
    return frame.agg(F.percentile_approx(value, F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("c")).first()["c"] or []


def text_cut_points(distinct: DataFrame, value: str, stretches: int = STRETCHES, sample: int = 100 * STRETCHES) -> list[str]:
    """Texts at nearly equal shares of the rows of ``distinct`` (one row a text), rising.

    The ``sample`` rows of the least hashes are a mergeable sketch whatever the texts
    look like; only they reach the driver.
    """
    kept = distinct.select(F.col(value).cast("string").alias("_v")).where(F.col("_v").isNotNull()).orderBy(F.xxhash64("_v"), "_v").limit(sample)
    found = sorted((r["_v"] for r in kept.collect()), key=lambda v: v.encode())
    return [found[i * len(found) // stretches] for i in range(1, stretches) if i * len(found) // stretches != (i - 1) * len(found) // stretches]


def stretch_of(value: Column, cuts: Sequence) -> tuple[Column, Column]:
    """The stretch of a value, a whole number that never falls as the value rises, and whether its stretch holds that value alone.

    Cut points that come up once part stretches below; repeated ones are stretches themselves.
    """
    once = sorted(set(cuts), key=lambda c: c.encode() if isinstance(c, str) else c)
    often = [c for c in once if list(cuts).count(c) > 1]
    if not once:
        return F.lit(0), F.lit(False)
    parts = [once[i : i + CHUNK] for i in range(0, len(once), CHUNK)]  # first the chunk, then the place in it; each is worked out once a row
    more = lambda cuts: F.size(F.filter(cuts, lambda c: c < value))
    whole = more(F.array(*[F.lit(p[-1]) for p in parts]))
    place = F.transform(F.array(whole), lambda at: at * CHUNK + F.greatest(F.coalesce(more(F.get(F.array(*[F.array(*map(F.lit, p)) for p in parts]), at)), F.lit(0)), F.lit(0)))
    below = F.least(F.get(place, F.lit(0)), F.lit(len(once)))
    single = F.array_contains(F.array(*map(F.lit, often)), value) if often else F.lit(False)
    return F.coalesce((2 * below + F.when(single, 1).otherwise(0)).cast("int"), F.lit(0)), single


def sums_before(frame: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], descending: bool = False) -> DataFrame:
    """``frame`` with ``<value>_before`` for each value: its sum over the key's rows of smaller ``order`` (greater, if descending).

    ``order`` is unique within a key (group by it first); nulls in it are dropped.
    Without earlier rows the sum is 0.
    """
    rows = frame.where(F.col(order).isNotNull())
    at, _ = stretch_of(F.col(order), cut_points(rows, order))
    rows = rows.withColumn("_stretch", at)
    by = [F.col(k) for k in keys]
    place = F.col("_stretch").desc() if descending else F.col("_stretch").asc()
    inner = F.col(order).desc() if descending else F.col(order).asc()
    sums = rows.groupBy(*keys, "_stretch").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    ahead = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_stretch", *[F.coalesce(F.sum(f"_{v}").over(ahead), F.lit(0)).alias(f"_{v}_ahead") for v in values])
    own = Window.partitionBy(*by, "_stretch").orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, [*keys, "_stretch"])
    out = joined.withColumns({f"{v}_before": F.col(f"_{v}_ahead") + F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values})
    return out.drop("_stretch", *[f"_{v}_ahead" for v in values])
