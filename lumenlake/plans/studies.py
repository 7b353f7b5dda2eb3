"""Whole studies composed of the operators: manifests, grouped cross-validation, locked evaluation, transfer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import bootstrap, extract, folds, learn, metrics, neardup, relational, resample, selection

# ------------------------------------------------------------------ manifests


def colour_manifest(info: DataFrame, images: DataFrame, masks: DataFrame, colours: DataFrame) -> DataFrame:
    """A manifest of images with coloured masks (green benign, red malignant).

    info (image, resolution as WxH, label, doppler, marks, combined), images and masks (name, height, width, sha256),
    colours (name, red_pixels, green_pixels, foreground_pixels).  patient_id is the
    name up to the first underscore; is_clean_primary is the conjunction of all
    conditions for the primary cohort.
    """
    label = F.lower(F.trim("label"))
    rows = info.join(images.select(F.col("name").alias("image"), F.col("height").alias("image_height"), F.col("width").alias("image_width"), F.col("sha256").alias("image_sha256")), "image")
    rows = rows.join(masks.select(F.col("name").alias("image"), F.col("height").alias("mask_height"), F.col("width").alias("mask_width"), F.col("sha256").alias("mask_sha256")), "image")
    rows = rows.join(colours.withColumnRenamed("name", "image"), "image")
    size = F.split(F.lower("resolution"), "x")
    geometry = (F.col("image_height") == F.col("mask_height")) & (F.col("image_width") == F.col("mask_width")) & (F.get(size, F.lit(0)).cast("int") == F.col("image_width")) & (F.get(size, F.lit(1)).cast("int") == F.col("image_height"))
    colour = F.when(label == "benign", (F.col("green_pixels") > 0) & (F.col("red_pixels") == 0)).when(label == "malignant", (F.col("red_pixels") > 0) & (F.col("green_pixels") == 0)).otherwise((F.col("red_pixels") == 0) & (F.col("green_pixels") == 0))
    out = rows.withColumns({
        "label": label,
        "patient_id": F.split_part(F.regexp_replace("image", r"\.[^.]*$", ""), F.lit("_"), F.lit(1)),
        "doppler": relational.truthy("doppler"),
        "marks": relational.truthy("marks"),
        "combined": relational.truthy("combined"),
        "is_lesion": label.isin("benign", "malignant"),
        "foreground_fraction": F.col("foreground_pixels") / (F.col("mask_height") * F.col("mask_width")),
        "geometry_consistent": geometry,
        "color_consistent": colour,
    })
    clean = F.col("is_lesion") & ~F.col("doppler") & ~F.col("marks") & ~F.col("combined") & (F.col("foreground_pixels") > 0) & F.col("color_consistent") & F.col("geometry_consistent")
    return out.withColumn("is_clean_primary", F.coalesce(clean, F.lit(False)))


def unreconciled(info: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    """Names that the metadata, the images or the masks lack: (image, missing_in)."""
    names = {"metadata": info.select("image"), "images": images.select(F.col("name").alias("image")), "masks": masks.select(F.col("name").alias("image"))}
    every = reduce(DataFrame.union, names.values()).distinct()
    return reduce(DataFrame.unionByName, [every.join(n.distinct(), "image", "left_anti").withColumn("missing_in", F.lit(k)) for k, n in names.items()])


def external_manifest(rows: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    """``rows`` (dataset, image, patient_id, label, ...) with accepted and exclusion_reason: the first rule that holds.

    images (image, width, height, file_sha256, pixel_sha256, dhash64), masks
    (image, mask_width, mask_height, mask_foreground_pixels, ...).
    """
    joined = rows.join(images, "image", "left").join(masks, "image", "left")
    rules = [
        ("missing_image", F.col("width").isNull()),
        ("missing_mask", F.col("mask_width").isNull()),
        ("unsupported_label", ~F.coalesce(F.lower("label").isin("benign", "malignant"), F.lit(False))),
        ("geometry_mismatch", (F.col("width") != F.col("mask_width")) | (F.col("height") != F.col("mask_height"))),
        ("empty_mask", F.col("mask_foreground_pixels") == 0),
    ]
    out = joined.withColumn("exclusion_reason", relational.first_reason(rules))
    return out.withColumn("accepted", F.col("exclusion_reason") == "")


def near_duplicate_manifest(images: DataFrame, key: str, label: str, distance: int = 5, least: float = 0.75) -> DataFrame:
    """Groups of pictures that look alike: key, group_id, group_size, cross_label_conflict, is_valid.

    images (key, label, height, width, pixels, mask).  Candidates by perceptual
    hash, confirmed by structural similarity, joined into components.
    """
    hashes = extract.audited(images, [key]).select(F.col(key).cast("string").alias(key), "phash")
    pairs = neardup.hamming_pairs(hashes, key, "phash", distance, 63)
    edges = extract.confirmed_pairs(pairs, images, key, least)
    labels = neardup.component_labels(hashes.select(F.col(key).alias("node")), edges.select("first", "second"))
    return neardup.visual_groups(labels, images.select(F.col(key).cast("string").alias("node"), label), label).withColumnRenamed("node", key)


# ------------------------------------------------------------------ cross-validation


def grouped_cv(frame: DataFrame, groups: Mapping[str, Sequence[str]], outer: int, inner: int, repeats: int, cs: Sequence[float], seed: int = 20260717) -> DataFrame:
    """Out-of-fold predictions of every feature group under the same outer and inner folds: group and the columns of ``selection.nested``.

    ``frame`` has image, patient_id, target and the features.
    """
    rows = frame.where(F.col("patient_id").isNotNull())
    runs = [selection.nested(rows, "patient_id", ["image"], columns, "target", repeats, outer, inner, seed, cs).withColumn("group", F.lit(name)) for name, columns in groups.items()]
    return reduce(DataFrame.unionByName, runs)


def cv_summary(predictions: DataFrame, groups: Sequence[str], reference: str, iterations: int, seed: int = 20260717) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``grouped_cv``: wide mean predictions, metrics of each group over repeats, and paired intervals against a reference."""
    repeat = relational.share_weight(predictions, ["group", "repeat", "patient_id"], "w")
    each = metrics.auc(repeat, ["group", "repeat"], "target", "probability", "w")
    rates = metrics.rates(metrics.confusion(repeat, ["group", "repeat"], "target", F.col("probability") >= 0.5, "w"))
    table = each.join(rates, ["group", "repeat"]).groupBy("group").agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("auc_sd"), *[F.avg(c).alias(c) for c in ("balanced_accuracy", "sensitivity", "specificity", "f1", "mcc")])
    wide = relational.wide(predictions, ["image", "patient_id", "target"], "group", groups, "probability")
    names = [f"probability_{g}" for g in groups]
    rows, draws = bootstrap.drawn(wide, "patient_id", iterations, seed)
    replicates = bootstrap.replicate_auc(rows, draws, "patient_id", "target", names)
    return wide, table, resample.paired_intervals(replicates, names, f"probability_{reference}")


# ------------------------------------------------------------------ locked evaluation


def external_metrics(frame: DataFrame, score: str, threshold: float) -> dict[str, float]:
    """The thirteen metrics of a score (image, patient_id, target, score) at a threshold set elsewhere."""
    rows = relational.share_weight(frame, ["patient_id"], "w")
    w = F.col("w")
    a, b = metrics.calibration(rows, "target", score, w)
    rate = metrics.rates(metrics.confusion(rows, [], "target", F.col(score) >= threshold, "w")).first()
    return {
        "group_balanced_roc_auc": metrics.auc(rows, [], "target", score, "w").first()["auc"],
        "image_roc_auc": metrics.auc(rows, [], "target", score).first()["auc"],
        "average_precision": metrics.average_precision(rows, [], "target", score, "w").first()["average_precision"],
        **{c: rate[c] for c in ("balanced_accuracy", "sensitivity", "specificity", "f1", "mcc")},
        "brier": rows.agg(metrics.brier("target", score, w).alias("b")).first()["b"],
        "calibration_intercept": a,
        "calibration_slope": b,
        "ece_10": metrics.ece(metrics.width_bins(rows, [], "target", score, w), []).first()["ece"],
        "threshold": float(threshold),
    }


def locked_predictions(frame: DataFrame, sources: Sequence[str], targets: Sequence[str], columns: Sequence[str], params: dict, model: str = "logistic", weight: str | None = None) -> DataFrame:
    """Predictions on each target of a model of each source and of their mean: dataset, image, patient_id, target, probability_<source>..., probability_ensemble."""
    if model == "logistic" and weight is None:
        scores, _ = selection.by_dataset(frame, "dataset", ["image", "patient_id"], columns, "target", {s: ([s], list(targets)) for s in sources}, params["c"])
    else:  # models of small tables
        plan = [(s, "train", s) for s in sources] + [(s, "test", t) for s in sources for t in targets]
        pairs = frame.sparkSession.createDataFrame(plan, "run string, part string, dataset string")
        scores = learn.transfer_scores(frame, pairs, ["image", "patient_id"], columns, "target", "dataset", model, params, weight)
    wide = relational.wide(scores, ["dataset", "image", "patient_id", "target"], "run", sources, "probability")
    mean = sum((F.col(f"probability_{s}") for s in sources), F.lit(0.0)) / len(sources)
    return wide.withColumn("probability_ensemble", mean)


def source_threshold(frame: DataFrame, source: str, columns: Sequence[str], n_folds: int, params: dict, seed: int, model: str = "logistic") -> float:
    """Youden's threshold of out-of-fold scores on one source."""
    rows = frame.where(F.col("dataset") == source)
    plan = folds.stratified_folds(rows, "patient_id", "target", n_folds, seed).select("patient_id", "fold").withColumn("repeat", F.lit(0))
    scores = learn.grid_scores(rows, plan, ["image", "patient_id"], columns, "target", "patient_id", model, [params])
    return metrics.youden(relational.share_weight(scores, ["patient_id"], "w"), [], "target", "probability", "w").first()["threshold"]


def compared_methods(wide: DataFrame, methods: Sequence[str], reference: str, iterations: int, seed: int = 20260717) -> DataFrame:
    """Paired differences of each method to the reference with adjusted p-values: score, mean, ci_low, ci_high, p_value, q."""
    rows, draws = bootstrap.drawn(wide, "patient_id", iterations, seed)
    table = resample.paired_intervals(bootstrap.replicate_auc(rows, draws, "patient_id", "target", list(methods)), list(methods), reference)
    return metrics.benjamini_hochberg(table.withColumn("family", F.lit("methods")), ["family"], "p_value", ["score"]).drop("family")


def transfer_matrix(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """``transfer_scores`` of runs named source>target as a square table of group-balanced AUCs, null on the diagonal."""
    rows = relational.share_weight(scores, ["run", "patient_id"], "w")
    table = metrics.auc(rows, ["run", "dataset"], "target", "probability", "w").withColumn("source", F.split_part("run", F.lit(">"), F.lit(1)))
    return table.groupBy("source").pivot("dataset", list(names)).agg(F.first("auc", ignorenulls=True))
