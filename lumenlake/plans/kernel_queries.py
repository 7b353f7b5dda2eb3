"""The kernels that the extractor ships, against SQL over the same pixels.

Pictures are 64 x 64 products of an embedding's entries in whole gray levels, each with
an ellipse of its own as mask, so that every kernel sees differing pictures and masks
and SQL can compute the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import lesion, raster
from lumenlake.operators import extract
from lumenlake.plans.registry import query, read

SIDE = 64
EPS = 2.220446049250313e-16


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, a: an embedding's entries in hundredths."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 100)).alias("a"))


def _picture(image: Column, a: str) -> tuple[Column, Column]:
    """Pixels and mask of a picture."""
    every = F.sequence(F.lit(0), F.lit(SIDE - 1))
    cy, cx = 24 + image % 16, 24 + F.shiftright(image, 4) % 16
    ry, rx = 8 + image % 11, 8 + image % 7
    plane = F.flatten(F.transform(every, lambda r: F.transform(every, lambda c: F.when((r == cy) & (c == cx), 0).when((r == cy) & (c == cx + 1), 255).otherwise(F.pmod(F.get(a, r) * F.get(a, c), F.lit(256))))))
    inside = F.flatten(F.transform(every, lambda r: F.transform(every, lambda c: ((r - cy) * (r - cy) * rx * rx + (c - cx) * (c - cx) * ry * ry <= rx * rx * ry * ry).cast("int"))))
    return plane.cast("array<double>"), inside


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, height, width, pixels (0 .. 255), mask."""
    plane, inside = _picture(F.col("image"), "a")
    return _entries(spark, sf_dir).select("image", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), plane.alias("pixels"), inside.alias("mask"))


#: The same pictures in SQL, a row a pixel: k is the gray level, v = k / 255.
GRIDS = """a AS (SELECT vec_id AS image, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)::BIGINT) AS a, 24 + vec_id % 16 AS cy, 24 + (vec_id // 16) % 16 AS cx, 8 + vec_id % 11 AS ry, 8 + vec_id % 7 AS rx FROM embeddings),
g AS (SELECT image, r, c, CASE WHEN r = cy AND c = cx THEN 0 WHEN r = cy AND c = cx + 1 THEN 255 ELSE (a[r + 1] * a[c + 1] % 256 + 256) % 256 END AS k, (r - cy) * (r - cy) * rx * rx + (c - cx) * (c - cx) * ry * ry <= rx * rx * ry * ry AS roi FROM a, range(64) t(r), range(64) s(c)),
px AS (SELECT image, r, c, k, k / 255.0::DOUBLE AS v, roi FROM g)"""
#: px with w, the value inside the mask and the mask's median outside.
FILLED = """md AS (SELECT image, (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 AS m FROM (SELECT image, list_sort(list(v)) AS l FROM px WHERE roi GROUP BY 1)),
fl AS (SELECT px.*, CASE WHEN roi THEN v ELSE m END AS w FROM px JOIN md USING (image))"""
_FIT = "CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / var_pop(x) ELSE 0 END"


def _round(frame: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return frame.select("image", *[(F.round(n, digits) + 0.0).alias(n) for n in names])  # no negative nought


_LEVELS = ["mean", "std", "q10", "q25", "median", "q75", "q90", "iqr", "entropy", "roi_fraction"]


@query(
    "kernel_gray_levels",
    f"""WITH {GRIDS}, h AS (SELECT image, least(31, k * 32 // 255) AS b, count(*)::DOUBLE AS n FROM px WHERE roi GROUP BY 1, 2), e AS (SELECT image, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY image) AS t FROM h) GROUP BY 1),
q AS (SELECT image, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.9) AS q90, count(*) / 4096.0::DOUBLE AS roi_fraction FROM px WHERE roi GROUP BY 1)
SELECT image, round(mean, 6) AS mean, round(std, 6) AS std, round(q10, 6) AS q10, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(q90, 6) AS q90, round(q75 - q25, 6) AS iqr, round(entropy, 6) AS entropy, round(roi_fraction, 6) AS roi_fraction FROM q JOIN e USING (image)""",
)
def kernel_gray_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(plane, mask):
        return {k.removeprefix("basic_"): v for k, v in lesion.basic(lesion.Lesion.of(plane, mask)).items()}

    return _round(extract.measured(grids(spark, sf_dir), ["image"], _LEVELS, kernel), _LEVELS)


_OFFSETS = [(dy, dx) for d in (1, 2, 4) for dy, dx in ((0, d), (round(d / 2**0.5), round(d / 2**0.5)), (d, 0), (round(d / 2**0.5), -round(d / 2**0.5)))]
_TEXTURE = ["glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_correlation"]


@query(
    "kernel_cooccurrence",
    f"""WITH {GRIDS}, {FILLED}, lv AS (SELECT image, r, c, least(31, greatest(0, round_even(w * 31, 0)))::INTEGER AS g FROM fl), o(o, dy, dx) AS (VALUES {", ".join(f"({i}, {dy}, {dx})" for i, (dy, dx) in enumerate(_OFFSETS))}),
ls AS (SELECT image, list(g ORDER BY r * 64 + c) AS l FROM lv GROUP BY 1),
d AS (SELECT image, o, l[r * 64 + c + 1] AS i, l[(r + dy) * 64 + c + dx + 1] AS j, count(*) AS n FROM ls, o, range(64) t(r), range(64) s(c) WHERE r + dy < 64 AND c + dx >= 0 AND c + dx < 64 GROUP BY 1, 2, 3, 4),
b AS (SELECT image, o, i, j, sum(n)::DOUBLE AS n FROM (SELECT * FROM d UNION ALL SELECT image, o, j, i, n FROM d) GROUP BY 1, 2, 3, 4),
p AS (SELECT image, o, i, j, n / sum(n) OVER (PARTITION BY image, o) AS p FROM b),
m AS (SELECT *, sum(p * i) OVER (PARTITION BY image, o) AS mu FROM p),
s AS (SELECT image, o, sum(p * (i - j) * (i - j)) AS contrast, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy, CASE WHEN sum(p * (i - mu) * (i - mu)) > 1e-30 THEN sum(p * (i - mu) * (j - mu)) / sum(p * (i - mu) * (i - mu)) ELSE 1 END AS correlation FROM m GROUP BY 1, 2)
SELECT image, round(avg(contrast), 5) AS glcm_contrast, round(avg(homogeneity), 5) AS glcm_homogeneity, round(avg(energy), 5) AS glcm_energy, round(avg(correlation), 5) + 0.0 AS glcm_correlation FROM s GROUP BY 1""",
)
def kernel_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 levels, distances 1, 2 and 4, four directions."""

    def kernel(plane, mask):
        return {k.removeprefix("basic_"): v for k, v in lesion.basic(lesion.Lesion.of(plane, mask)).items()}

    return _round(extract.measured(grids(spark, sf_dir), ["image"], _TEXTURE, kernel), _TEXTURE, 5)


_FRACTAL = ["boundary_boxdim", "boundary_boxdim_r2", "region_boxdim", "region_boxdim_r2", "gray_dbc_slope", "gray_dbc_r2", "lacunarity_s4", "lacunarity_s8", "lacunarity_s16", "lacunarity_s32", "lacunarity_mean"]
_R2 = f"CASE WHEN count(*) >= 3 THEN 1 - count(*) * greatest(var_pop(y) - covar_pop(x, y) / var_pop(x) * covar_pop(x, y), 0) / greatest(count(*) * var_pop(y), {EPS}) ELSE 0 END"


@query(
    "kernel_fractal",
    f"""WITH {GRIDS}, {FILLED},
er AS (SELECT p.image, p.r, p.c, bool_or(NOT q.roi) AS edge FROM px p JOIN px q ON q.image = p.image AND p.roi AND (q.r - p.r) * (q.r - p.r) + (q.c - p.c) * (q.c - p.c) <= 1 AND q.r BETWEEN p.r - 1 AND p.r + 1 GROUP BY 1, 2, 3),
ms AS (SELECT image, 'boundary' AS what, r, c FROM er WHERE edge UNION ALL SELECT image, 'region', r, c FROM px WHERE roi),
bx AS (SELECT image, what, s, count(DISTINCT (r // s) * 64 + c // s) AS n FROM ms, (VALUES (2), (4), (8), (16), (32), (64)) t(s) GROUP BY 1, 2, 3),
bd AS (SELECT image, what, {_FIT} AS slope, {_R2} AS r2 FROM (SELECT image, what, -ln(s) AS x, ln(n) AS y FROM bx) GROUP BY 1, 2),
db AS (SELECT image, s, sum(n) AS n FROM (SELECT image, s, greatest(1, ceil((max(w) - min(w)) * 255 / s)) AS n FROM fl, (VALUES (4), (8), (16), (32), (64)) t(s) GROUP BY image, s, r // s, c // s) GROUP BY 1, 2),
dd AS (SELECT image, {_FIT} AS slope, {_R2} AS r2 FROM (SELECT image, -ln(s) AS x, ln(n) AS y FROM db) GROUP BY 1),
la AS (SELECT image, s, var_pop(m) / greatest(avg(m) * avg(m), {EPS}) + 1 AS l FROM (SELECT image, s, sum(roi::INTEGER)::DOUBLE AS m FROM px, (VALUES (4), (8), (16), (32)) t(s) GROUP BY image, s, r // s, c // s) GROUP BY 1, 2),
ll AS (SELECT image, max(l) FILTER (WHERE s = 4) AS s4, max(l) FILTER (WHERE s = 8) AS s8, max(l) FILTER (WHERE s = 16) AS s16, max(l) FILTER (WHERE s = 32) AS s32, avg(l) AS m FROM la GROUP BY 1)
SELECT dd.image, round(b.slope, 6) AS boundary_boxdim, round(b.r2, 6) AS boundary_boxdim_r2, round(r.slope, 6) AS region_boxdim, round(r.r2, 6) AS region_boxdim_r2, round(dd.slope, 6) AS gray_dbc_slope, round(dd.r2, 6) AS gray_dbc_r2, round(s4, 6) AS lacunarity_s4, round(s8, 6) AS lacunarity_s8, round(s16, 6) AS lacunarity_s16, round(s32, 6) AS lacunarity_s32, round(m, 6) AS lacunarity_mean
FROM dd JOIN ll USING (image) JOIN bd b ON b.image = dd.image AND b.what = 'boundary' JOIN bd r ON r.image = dd.image AND r.what = 'region'""",
)
def kernel_fractal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box dimensions of boundary and region, differential box counting and lacunarity, at the shipped sizes."""

    def kernel(plane, mask):
        return {k.removeprefix("fractal_"): v for k, v in lesion.fractal(lesion.Lesion.of(plane, mask)).items()}

    return _round(extract.measured(grids(spark, sf_dir), ["image"], _FRACTAL, kernel), _FRACTAL)


_DIMENSIONS = ["d0", "d1", "d2", "spread", "r2_mean"]


@query(
    "kernel_dimensions",
    f"""WITH {GRIDS}, m AS (SELECT image, r, c, v - min(v) OVER (PARTITION BY image) + 1 / 255.0::DOUBLE AS v FROM px WHERE roi),
b AS (SELECT image, s, sum(v) AS m FROM m, (VALUES (4), (8), (16), (32)) t(s) GROUP BY image, s, r // s, c // s),
p AS (SELECT image, s, m / sum(m) OVER (PARTITION BY image, s) AS p FROM b),
y AS (SELECT image, s, count(*) AS n, ln(count(*)) AS y0, -sum(p * ln(p + {EPS})) AS y1, -ln(sum(p * p) + {EPS}) AS y2 FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
l AS (SELECT image, 0 AS d, -ln(s) AS x, y0 AS y FROM y UNION ALL SELECT image, 1, -ln(s), y1 FROM y UNION ALL SELECT image, 2, -ln(s), y2 FROM y),
f AS (SELECT image, d, {_FIT} AS slope, {_R2} AS r2 FROM l GROUP BY 1, 2)
SELECT image, round(max(slope) FILTER (WHERE d = 0), 6) AS d0, round(max(slope) FILTER (WHERE d = 1), 6) AS d1, round(max(slope) FILTER (WHERE d = 2), 6) AS d2, round(max(slope) - min(slope), 6) AS spread, round(avg(r2), 6) AS r2_mean FROM f GROUP BY 1""",
)
def kernel_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity, information and correlation dimension of the intensity measure inside the mask."""

    def kernel(plane, mask):
        measure = np.where(mask, plane - plane[mask].min() + 1 / 255, 0.0)
        return lesion.generalised_dimensions(measure, mask)

    return _round(extract.measured(grids(spark, sf_dir), ["image"], _DIMENSIONS, kernel), _DIMENSIONS)


_WINDOW = 7


@query(
    "kernel_similarity",
    f"""WITH {GRIDS}, xy AS (SELECT a.image, a.r, a.c, a.v AS x, b.v AS y FROM px a JOIN px b ON b.image = a.image + 1 AND b.r = a.r AND b.c = a.c),
row_sums AS (SELECT image, r, c, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(x * x) OVER w AS xx, sum(y * y) OVER w AS yy, sum(x * y) OVER w AS xy, count(*) OVER w AS n FROM xy WINDOW w AS (PARTITION BY image, r ORDER BY c ROWS BETWEEN {_WINDOW - 1} PRECEDING AND CURRENT ROW)),
win AS (SELECT image, sum(x) OVER w / 49 AS x, sum(y) OVER w / 49 AS y, sum(xx) OVER w / 49 AS xx, sum(yy) OVER w / 49 AS yy, sum(xy) OVER w / 49 AS xy, sum(n) OVER w AS n FROM row_sums WINDOW w AS (PARTITION BY image, c ORDER BY r ROWS BETWEEN {_WINDOW - 1} PRECEDING AND CURRENT ROW)),
v AS (SELECT image, x, y, 49 / 48.0::DOUBLE * (xx - x * x) AS vx, 49 / 48.0::DOUBLE * (yy - y * y) AS vy, 49 / 48.0::DOUBLE * (xy - x * y) AS vxy FROM win WHERE n = 49),
s AS (SELECT image, avg((2 * x * y + 0.0001) * (2 * vxy + 0.0009) / ((x * x + y * y + 0.0001) * (vx + vy + 0.0009))) AS ssim FROM v GROUP BY 1),
k AS (SELECT image, corr(x, y) AS pearson FROM xy GROUP BY 1)
SELECT image, round(ssim, 6) AS ssim, round(pearson, 6) AS pearson FROM s JOIN k USING (image)""",
)
def kernel_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity and correlation of each picture with the next one; entries are joined and dealt, not pixels."""
    rows = _entries(spark, sf_dir)
    pairs = rows.join(rows.select((F.col("image") - 1).alias("image"), F.col("a").alias("b")), "image").repartition(8 * spark.sparkContext.defaultParallelism)
    pairs = pairs.select("image", _picture(F.col("image"), "a")[0].alias("pixels"), _picture(F.col("image") + 1, "b")[0].alias("mask"))

    def both(batches):
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy().reshape(-1, SIDE, SIDE) / 255.0 for i in (1, 2))
            ssim = [raster.similarity(a, b) for a, b in zip(x, y, strict=True)]
            pearson = [float(np.corrcoef(a.ravel(), b.ravel())[0, 1]) for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ssim), pa.array(pearson)], names=["image", "ssim", "pearson"])

    found = extract.batches(pairs, both, "image long, ssim double, pearson double")
    return _round(found, ["ssim", "pearson"])
