"""Feature extraction over a table of images and masks.

Rows are (keys, height, width, pixels, mask); pixels and mask are arrays in row
order.  A task reads Arrow batches, prepares each picture once and writes one
wide row of doubles in registry order.  A picture that fails keeps its keys, null
features and the reason, so failures are rows and not lost tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions import lesion, perturb, raster
from lumenlake.functions.registry import FAMILIES
from lumenlake.session import deal, ship, spread

#: Pictures of an Arrow batch.
BATCH_ROWS = 64


def _planes(batch: pa.RecordBatch, at: int, dtype):
    return [None if v is None else np.asarray(v, dtype=dtype) for v in (x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch.column(at))]


def batches(frame: DataFrame, run, schema) -> DataFrame:
    """``run`` over Arrow batches of BATCH_ROWS pictures, however many a task has; ``frame`` is dealt over tasks."""
    spark = frame.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return frame.mapInArrow(run, schema)


def extract(images: DataFrame, keys: Sequence[str], families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """keys, the features of the families, failure (null where it worked).

    Null pixels or masks, wrong sizes and pictures without a usable lesion give a failure.
    """
    columns = [c for f in families for c in FAMILIES[f]]
    key_fields = [images.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *[T.StructField(c, T.DoubleType()) for c in columns], T.StructField("failure", T.StringType())])
    chosen = tuple(families)
    n_keys = len(keys)

    def run(batches):
        for batch in batches:
            values = np.full((batch.num_rows, len(columns)), np.nan)
            failures: list[str | None] = []
            heights, widths = batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist()
            for i, (h, w, pixels, mask) in enumerate(zip(heights, widths, _planes(batch, n_keys + 2, np.float64), _planes(batch, n_keys + 3, np.float64), strict=True)):
                try:
                    if pixels is None or mask is None or h is None or w is None:
                        raise ValueError("missing image or mask")
                    if pixels.size != h * w or mask.size != h * w:
                        raise ValueError("pixels do not fit the size")
                    found = lesion.features(pixels.reshape(h, w), mask.reshape(h, w), chosen)
                    values[i] = [found[c] for c in columns]
                    failures.append(None)
                except (ValueError, RuntimeError) as e:
                    failures.append(f"{type(e).__name__}: {e}")
            bad = np.array([f is not None for f in failures], dtype=bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *[pa.array(values[:, j], mask=bad) for j in range(len(columns))], pa.array(failures, pa.string())], names=[*keys, *columns, "failure"])

    return batches(deal(images.select(*keys, "height", "width", "pixels", "mask")), run, schema)


def measured(images: DataFrame, keys: Sequence[str], names: Sequence[str], kernel) -> DataFrame:
    """keys and a column for each name of what ``kernel(plane, mask)`` gives for a picture as it is: neither cut nor sized, pixels in 0 .. 255 scaled to 0 .. 1."""
    schema = T.StructType([*[images.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]])
    n = len(keys)

    def run(batches):
        for batch in batches:
            shapes = zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)
            planes = zip(shapes, _planes(batch, n + 2, np.float64), _planes(batch, n + 3, np.float64), strict=True)
            found = [kernel(pixels.reshape(shape) / 255.0, mask.reshape(shape) > 0) for shape, pixels, mask in planes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array([float(f[c]) for f in found]) for c in names]], names=[*keys, *names])

    return batches(deal(images.select(*keys, "height", "width", "pixels", "mask")), run, schema)


def require_extracted(features: DataFrame, sink) -> DataFrame:
    """Write failures through ``sink`` and raise if there are any; else the rows without the failure column."""
    failed = features.where("failure IS NOT NULL")
    n = failed.count()
    if n:
        sink(failed)
        raise RuntimeError(f"{n} images failed; see the failure log")
    return features.drop("failure")


def perturbed(images: DataFrame, keys: Sequence[str], dataset: str, conditions: Sequence[str] = perturb.CONDITIONS) -> DataFrame:
    """Images (8-bit) once for each condition: keys, condition, height, width, pixels, mask; a failing one is left null."""
    spark = images.sparkSession
    table = spark.createDataFrame([(c,) for c in conditions], "condition string")
    rows = deal(images.select(*keys, "height", "width", "pixels", "mask")).crossJoin(F.broadcast(table))
    key_fields = [images.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("condition", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.DoubleType())), T.StructField("mask", T.ArrayType(T.IntegerType()))])
    n = len(keys)

    def run(batches):
        for batch in batches:
            out_pixels, out_masks = [], []
            names, hs, ws = batch.column(0).to_pylist(), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            for name, h, w, pixels, mask, condition in zip(names, hs, ws, _planes(batch, n + 2, np.float64), _planes(batch, n + 3, np.float64), batch.column(n + 4).to_pylist(), strict=True):
                try:
                    image, changed = perturb.perturb(pixels.reshape(h, w), mask.reshape(h, w), dataset, str(name), condition)
                    out_pixels.append(image.ravel().astype(float))
                    out_masks.append(np.asarray(changed).ravel().astype(np.int32))
                except (ValueError, AttributeError):
                    out_pixels.append(None)
                    out_masks.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n + 4), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()), pa.array(out_pixels, pa.list_(pa.float64())), pa.array(out_masks, pa.list_(pa.int32()))], names=[*keys, "condition", "height", "width", "pixels", "mask"])

    return batches(rows, run, schema)


def jittered(images: DataFrame, keys: Sequence[str], amplitudes: Sequence[float] = (0.025, 0.05), seeds: Sequence[int] = (20260718, 20260719, 20260720, 20260721, 20260722), shown: Column | None = None) -> DataFrame:
    """Masks (or ``shown``, made of them where they are dealt) moved at random: keys, condition, jitter_amplitude_equivalent_radius, jitter_seed, perturbed_mask_foreground_pixels, mask."""
    spark = images.sparkSession
    table = spark.createDataFrame([(f"jitter_{a:g}_{s}", float(a), int(s)) for a in amplitudes for s in seeds], "condition string, amplitude double, seed long")
    rows = deal(images.select(*keys, "height", "width", "mask"))
    if shown is not None:
        rows = rows.withColumn("mask", shown)
    rows = rows.crossJoin(F.broadcast(table))
    schema = T.StructType([*[images.schema[k] for k in keys], T.StructField("condition", T.StringType()), T.StructField("jitter_amplitude_equivalent_radius", T.DoubleType()), T.StructField("jitter_seed", T.LongType()), T.StructField("perturbed_mask_foreground_pixels", T.LongType()), T.StructField("mask", T.ArrayType(T.IntegerType()))])
    n = len(keys)

    def run(batches):
        for batch in batches:
            masks, sizes = [], []
            for name, h, w, mask, a, s in zip(batch.column(0).to_pylist(), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), _planes(batch, n + 2, np.float64), batch.column(n + 4).to_pylist(), batch.column(n + 5).to_pylist(), strict=True):
                try:
                    moved = perturb.jitter(mask.reshape(h, w), a, s, str(name))
                    masks.append(moved.ravel().astype(np.int32))
                    sizes.append(int(moved.sum()))
                except (ValueError, AttributeError):
                    masks.append(None)
                    sizes.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n + 3), batch.column(n + 4), batch.column(n + 5), pa.array(sizes, pa.int64()), pa.array(masks, pa.list_(pa.int32()))], names=schema.names)

    return batches(rows, run, schema)


def audited(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pixel_sha256, dhash64 (16 hexadecimal digits), phash (63 bits), dhash (long), mask_foreground_pixels, mask_foreground_fraction.

    The pixel digest covers the shape as two little-endian 64-bit integers and the
    8-bit pixels; the mask counts every positive pixel.
    """
    import hashlib

    schema = T.StructType([*[images.schema[k] for k in keys], T.StructField("pixel_sha256", T.StringType()), T.StructField("dhash64", T.StringType()), T.StructField("dhash", T.LongType()), T.StructField("phash", T.LongType()), T.StructField("mask_foreground_pixels", T.LongType()), T.StructField("mask_foreground_fraction", T.DoubleType())])
    n = len(keys)

    def run(batches):
        for batch in batches:
            rows = []
            for h, w, pixels, mask in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), _planes(batch, n + 2, np.float64), _planes(batch, n + 3, np.float64), strict=True):
                if pixels is None or mask is None or h is None or w is None or pixels.size != h * w:
                    rows.append((None,) * 6)
                    continue
                gray = np.clip(pixels, 0, 255).astype(np.uint8).reshape(h, w)
                d = raster.difference_hash(gray)
                digest = hashlib.sha256(np.array([h, w], "<i8").tobytes() + gray.tobytes()).hexdigest()
                rows.append((digest, f"{d:016x}", d - (1 << 64) if d >> 63 else d, raster.dct_sign_hash(gray), int((mask > 0).sum()), float((mask > 0).mean())))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]], names=schema.names)

    return batches(deal(images.select(*keys, "height", "width", "pixels", "mask")), run, schema)


def confirmed_pairs(pairs: DataFrame, images: DataFrame, key: str, least: float = 0.75, side: int = 256) -> DataFrame:
    """``pairs`` (first, second, hamming) whose pictures are alike: with ssim_256 and correlation_256, ssim at least ``least``."""
    schema = "first string, second string, hamming int, ssim_256 double, correlation_256 double"
    part = images.select(F.col(key).cast("string").alias("k"), F.struct("height", "width", "pixels").alias("p"))
    rows = pairs.select(F.col("first").cast("string").alias("first"), F.col("second").cast("string").alias("second"), "hamming")
    rows = rows.join(part.select(F.col("k").alias("first"), F.col("p").alias("a")), "first").join(part.select(F.col("k").alias("second"), F.col("p").alias("b")), "second")

    def plane(p):
        gray = np.clip(np.asarray(p["pixels"], float), 0, 255).astype(np.uint8).reshape(p["height"], p["width"])
        return raster.resize_u8(gray, (side, side)) / 255.0

    def run(batches):
        for batch in batches:
            out = []
            for first, second, hamming, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = plane(a), plane(b)
                s = raster.similarity(x, y)
                if s >= least:
                    flat = x.std() == 0 or y.std() == 0
                    out.append((first, second, hamming, s, None if flat else float(np.corrcoef(x.ravel(), y.ravel())[0, 1])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["first", "second", "hamming", "ssim_256", "correlation_256"])

    return batches(spread(rows.select("first", "second", "hamming", "a", "b")), run, schema)
