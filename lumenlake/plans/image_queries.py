"""Queries of image features: those that SQL expresses over pixels, and the extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.registry import FAMILIES
from lumenlake.operators import extract
from lumenlake.plans.registry import query, read
from lumenlake.plans.views import PIXELS, pictures, pixels


def _sizes(frame: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Each pixel once for each square size, with the square's row and column."""
    rows = frame.withColumn("s", F.explode(F.array(*map(F.lit, sizes))))
    return rows.withColumns({"br": F.expr("r div s"), "bc": F.expr("c div s")})


def _fit(frame: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, slope, r2 of a line through each key's points; (0, 0) for fewer than three or one x."""
    rows = frame.select(*keys, x.alias("_x"), y.alias("_y"))
    out = rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.var_pop("_x").alias("_vx"), F.covar_pop("_x", "_y").alias("_cv"), F.var_pop("_y").alias("_vy"))
    fine = (F.col("_n") >= 3) & (F.col("_vx") > 1e-16)
    slope = F.col("_cv") / F.col("_vx")
    rest = F.greatest(F.col("_vy") - slope * F.col("_cv"), F.lit(0.0))
    return out.select(*keys, F.when(fine, slope).otherwise(0.0).alias("slope"), F.when(fine, 1 - F.col("_n") * rest / F.greatest(F.col("_n") * F.col("_vy"), F.lit(2.220446049250313e-16))).otherwise(0.0).alias("r2"))


_FIT = "CASE WHEN count(*) >= 3 AND var_pop(x) > 1e-16 THEN covar_pop(x, y) / var_pop(x) ELSE 0 END"
_R2 = "CASE WHEN count(*) >= 3 AND var_pop(x) > 1e-16 THEN 1 - count(*) * greatest(var_pop(y) - covar_pop(x, y) / var_pop(x) * covar_pop(x, y), 0) / greatest(count(*) * var_pop(y), 2.220446049250313e-16) ELSE 0 END"


@query("pixel_quantiles", f"WITH {PIXELS} SELECT image, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.9), 6) AS q90, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM pixels GROUP BY 1")
def pixel_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda at: F.percentile("v", F.lit(at))
    return pixels(spark, sf_dir).groupBy("image").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), *[F.round(q(a), 6).alias(n) for n, a in (("q10", 0.1), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q90", 0.9))], F.round(q(0.75) - q(0.25), 6).alias("iqr"))


@query("histogram_entropy", f"WITH {PIXELS}, e AS (SELECT image, min(v) AS lo, max(v) AS hi, count(*) AS n FROM pixels GROUP BY 1), h AS (SELECT image, least(31, floor((v - lo) / (hi - lo) * 32))::INTEGER AS b, count(*) / max(n)::DOUBLE AS p FROM pixels JOIN e USING (image) GROUP BY 1, 2) SELECT image, round(-sum(p * log2(p)), 6) AS entropy FROM h GROUP BY 1")
def histogram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir)
    ends = rows.groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    b = F.least(F.lit(31), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 32))
    h = rows.join(ends, "image").groupBy("image", b.cast("int").alias("b")).agg((F.count(F.lit(1)) / F.max("n")).alias("p"))
    return h.groupBy("image").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query("box_count_dimension", f"WITH {PIXELS}, b AS (SELECT image, s, count(DISTINCT (r // s) * 8 + c // s) AS n FROM pixels, (VALUES (1), (2), (4)) t(s) WHERE v > 0 GROUP BY 1, 2), p AS (SELECT image, -ln(s) AS x, ln(n) AS y FROM b) SELECT image, round({_FIT}, 6) AS slope, round({_R2}, 5) AS r2 FROM p GROUP BY 1")
def box_count_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _sizes(pixels(spark, sf_dir).where("v > 0"), (1, 2, 4)).groupBy("image", "s").agg(F.count_distinct(F.col("br") * 8 + F.col("bc")).alias("n"))
    fit = _fit(boxes, ["image"], -F.log(F.col("s")), F.log(F.col("n")))
    return fit.select("image", F.round("slope", 6).alias("slope"), F.round("r2", 5).alias("r2"))


@query("lacunarity", f"WITH {PIXELS}, b AS (SELECT image, s, r // s AS br, c // s AS bc, sum((v > 0)::INTEGER)::DOUBLE AS m FROM pixels, (VALUES (2), (4)) t(s) GROUP BY 1, 2, 3, 4) SELECT image, s AS size, round(var_pop(m) / greatest(pow(avg(m), 2), 2.220446049250313e-16) + 1, 6) AS lacunarity FROM b GROUP BY 1, 2")
def lacunarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = _sizes(pixels(spark, sf_dir), (2, 4)).groupBy("image", "s", "br", "bc").agg(F.sum((F.col("v") > 0).cast("double")).alias("m"))
    return mass.groupBy("image", F.col("s").alias("size")).agg(F.round(F.var_pop("m") / F.greatest(F.avg("m") ** 2, F.lit(2.220446049250313e-16)) + 1, 6).alias("lacunarity"))


@query("differential_box_slope", f"WITH {PIXELS}, b AS (SELECT image, s, r // s AS br, c // s AS bc, greatest(1, ceil(round((max(v) - min(v)) * 255 / s, 9))) AS n FROM pixels, (VALUES (2), (4), (8)) t(s) GROUP BY 1, 2, 3, 4), p AS (SELECT image, -ln(s) AS x, ln(sum(n)) AS y FROM b GROUP BY image, s) SELECT image, round({_FIT}, 6) AS slope, round({_R2}, 5) AS r2 FROM p GROUP BY 1")
def differential_box_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _sizes(pixels(spark, sf_dir), (2, 4, 8)).groupBy("image", "s", "br", "bc").agg(F.greatest(F.lit(1.0), F.ceil(F.round((F.max("v") - F.min("v")) * 255 / F.col("s"), 9)).cast("double")).alias("n"))
    fit = _fit(boxes.groupBy("image", "s").agg(F.sum("n").alias("n")), ["image"], -F.log(F.col("s")), F.log(F.col("n")))
    return fit.select("image", F.round("slope", 6).alias("slope"), F.round("r2", 5).alias("r2"))


@query("generalized_dimensions", f"WITH {PIXELS}, m AS (SELECT image, r, c, v - min(v) OVER (PARTITION BY image) + 1 / 255.0::DOUBLE AS v FROM pixels), b AS (SELECT image, s, r // s AS br, c // s AS bc, sum(v) AS m FROM m, (VALUES (1), (2), (4)) t(s) GROUP BY 1, 2, 3, 4), q AS (SELECT *, m / sum(m) OVER (PARTITION BY image, s) AS p FROM b), y AS (SELECT image, s, ln(count(*)) AS y0, -sum(p * ln(p + 2.220446049250313e-16)) AS y1, -ln(sum(p * p) + 2.220446049250313e-16) AS y2 FROM q GROUP BY 1, 2), l AS (SELECT image, 0 AS d, -ln(s) AS x, y0 AS y FROM y UNION ALL SELECT image, 1, -ln(s), y1 FROM y UNION ALL SELECT image, 2, -ln(s), y2 FROM y) SELECT image, d, round({_FIT}, 6) AS dimension FROM l GROUP BY 1, 2")
def generalized_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir)
    low = rows.groupBy("image").agg(F.min("v").alias("low"))
    mass = _sizes(rows.join(low, "image").withColumn("v", F.col("v") - F.col("low") + 1 / 255), (1, 2, 4)).groupBy("image", "s", "br", "bc").agg(F.sum("v").alias("m"))
    # sums of m, m ln m and m * m give the entropies without another pass
    eps = 2.220446049250313e-16
    from pyspark.sql import Window

    p = mass.withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy("image", "s")))
    y = p.groupBy("image", "s").agg(F.log(F.count(F.lit(1))).alias("y0"), (-F.sum(F.col("p") * F.log(F.col("p") + eps))).alias("y1"), (-F.log(F.sum(F.col("p") ** 2) + eps)).alias("y2"))
    long = y.select("image", "s", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(f"y{i}").alias("y")) for i in range(3)])).alias("q"))
    fit = _fit(long.select("image", "s", "q.d", "q.y"), ["image", "d"], -F.log(F.col("s")), F.col("y"))
    return fit.select("image", "d", F.round("slope", 6).alias("dimension"))


@query("cooccurrence", f"WITH {PIXELS}, q AS (SELECT image, r, c, least(7, floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 8))::INTEGER AS g FROM pixels WINDOW w AS (PARTITION BY image)), p AS (SELECT a.image, a.g AS i, b.g AS j FROM q a JOIN q b ON a.image = b.image AND a.r = b.r AND a.c + 1 = b.c UNION ALL SELECT a.image, b.g, a.g FROM q a JOIN q b ON a.image = b.image AND a.r = b.r AND a.c + 1 = b.c), n AS (SELECT image, i, j, count(*) / sum(count(*)) OVER (PARTITION BY image)::DOUBLE AS p FROM p GROUP BY 1, 2, 3) SELECT image, round(sum(p * (i - j) * (i - j)), 6) AS contrast, round(sum(p / (1 + (i - j) * (i - j))), 6) AS homogeneity, round(sqrt(sum(p * p)), 6) AS energy FROM n GROUP BY 1")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric co-occurrence of eight gray levels one pixel to the right, within a picture's own row of 64 values."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    low, high = F.array_min("x"), F.array_max("x")
    rows = rows.select("image", F.transform("x", lambda v: F.least(F.lit(7), F.floor((v - low) / (high - low) * 8)).cast("int")).alias("g"))
    at = [i for i in range(64) if i % 8 < 7]
    pairs = F.explode(F.array(*[F.struct(F.col("g")[i].alias("i"), F.col("g")[i + 1].alias("j")) for i in at], *[F.struct(F.col("g")[i + 1].alias("i"), F.col("g")[i].alias("j")) for i in at]))
    n = rows.select("image", pairs.alias("q")).groupBy("image", "q.i", "q.j").agg((F.count(F.lit(1)) / F.lit(2.0 * len(at))).alias("p"))
    gap = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))
    return n.groupBy("image").agg(F.round(F.sum(F.col("p") * gap), 6).alias("contrast"), F.round(F.sum(F.col("p") / (1 + gap)), 6).alias("homogeneity"), F.round(F.sqrt(F.sum(F.col("p") ** 2)), 6).alias("energy"))


@query("mask_audit", f"WITH {PIXELS} SELECT image, count(*) FILTER (WHERE v > 0) AS foreground_pixels, round(count(*) FILTER (WHERE v > 0) / count(*)::DOUBLE, 6) AS foreground_fraction, string_agg(DISTINCT sign(v)::INTEGER::VARCHAR, '|' ORDER BY sign(v)::INTEGER::VARCHAR) AS mask_values FROM pixels GROUP BY 1")
def mask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("image").agg(F.count_if(F.col("v") > 0).alias("foreground_pixels"), F.round(F.count_if(F.col("v") > 0) / F.count(F.lit(1)), 6).alias("foreground_fraction"), F.array_join(F.sort_array(F.collect_set(F.signum("v").cast("int").cast("string"))), "|").alias("mask_values"))


def _extractor(family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract.extract(pictures(spark, sf_dir), ["image"], [family])

    run.__doc__ = f"The {family} features of every picture; tests hold the kernels against analytic cases and brute force."
    return run


for _family in FAMILIES:
    query(f"extract_{_family}")(_extractor(_family))


@query("image_audit")
def image_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.audited(pictures(spark, sf_dir), ["image"])


@query("perturbed_images")
def perturbed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.perturbed(pictures(spark, sf_dir), ["image"], "embeddings")


@query("jittered_masks")
def jittered_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks on a grid four times as fine, so that they are large enough to be moved."""
    rows = pictures(spark, sf_dir)
    fine = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda c: F.get(F.col("mask"), (F.floor(r / 4) * 8 + F.floor(c / 4)).cast("int")))))
    return extract.jittered(rows.select("image", F.lit(32).alias("height"), F.lit(32).alias("width"), "mask"), ["image"], shown=fine)
