"""Queries of weighted metrics, calibration, bootstrap, near duplicates and groups."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import bootstrap, metrics, neardup, relational, resample
from lumenlake.plans.registry import query, read
from lumenlake.plans.views import COHORT, VISITS, cohort, visits


def _w(frame: DataFrame) -> DataFrame:
    return relational.share_weight(frame, ["patient_id"], "w")


_W = f"WITH {COHORT}, c AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY patient_id) AS w FROM cohort)"


def _auc_sql(source: str, keys: str, score: str, weight: str) -> str:
    """AUC by running sums, for a relation ``source``."""
    return f"""SELECT {keys}, sum(wp * (before + wn / 2)) / (sum(wp) * sum(wn)) AS auc FROM (
      SELECT *, coalesce(sum(wn) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT {keys}, {score} AS s, sum(CASE WHEN target = 1 THEN {weight} ELSE 0 END) AS wp, sum(CASE WHEN target = 0 THEN {weight} ELSE 0 END) AS wn FROM {source} GROUP BY {keys}, {score}))
      GROUP BY {keys} HAVING sum(wp) > 0 AND sum(wn) > 0"""


@query("weighted_auc", f"{_W} SELECT dataset, round(auc, 6) AS auc FROM ({_auc_sql('c', 'dataset', 'p_base', 'w')})")
def weighted_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_w(cohort(spark, sf_dir)), ["dataset"], "target", "p_base", "w").withColumn("auc", F.round("auc", 6))


@query("continuous_auc", f"{_W} SELECT dataset, round(auc, 6) AS auc FROM ({_auc_sql('c', 'dataset', 'price', '1.0')})")
def continuous_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of as many values as rows, unweighted."""
    return metrics.auc(cohort(spark, sf_dir), ["dataset"], "target", "price").withColumn("auc", F.round("auc", 6))


@query("subgroup_auc", f"{_W}, s AS (SELECT *, (part % 5)::BIGINT AS stratum FROM c), big AS (SELECT stratum, count(*) AS n, count(DISTINCT patient_id) AS patients FROM s GROUP BY 1 HAVING count(*) >= 100 AND sum(target) >= 20 AND sum(1 - target) >= 20) SELECT stratum, n, patients, round(auc, 6) AS auc FROM big JOIN ({_auc_sql('s', 'stratum', 'p_alt', 'w')}) USING (stratum)")
def subgroup_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _w(cohort(spark, sf_dir)).withColumn("stratum", F.col("part") % 5)
    big = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("patients"), F.sum("target").alias("p"))
    big = big.where("n >= 100 AND p >= 20 AND n - p >= 20").drop("p")
    return big.join(metrics.auc(rows, ["stratum"], "target", "p_alt", "w"), "stratum").withColumn("auc", F.round("auc", 6))


@query("repeat_metrics", f"{_W}, r AS (SELECT *, (part % 4)::BIGINT AS repeat FROM c) SELECT dataset, round(avg(auc), 6) AS mean_auc, round(stddev_samp(auc), 6) AS sd_auc, count(*) AS repeats FROM ({_auc_sql('r', 'dataset, repeat', 'p_base', 'w')}) GROUP BY 1")
def repeat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _w(cohort(spark, sf_dir)).withColumn("repeat", F.col("part") % 4)
    each = metrics.auc(rows, ["dataset", "repeat"], "target", "p_base", "w")
    return each.groupBy("dataset").agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.stddev_samp("auc"), 6).alias("sd_auc"), F.count(F.lit(1)).alias("repeats"))


@query("development_score", f"{_W}, l AS (SELECT dataset, (part % 2)::BIGINT AS role, 'base' AS model, p_base AS p, target, w FROM c UNION ALL SELECT dataset, (part % 2)::BIGINT, 'alt', p_alt, target, w FROM c), a AS ({_auc_sql('l', 'model, dataset, role', 'p', 'w')}) SELECT model, round(avg(auc), 6) AS development_score, round(min(auc) FILTER (WHERE role = 1), 6) AS min_transfer FROM a GROUP BY 1")
def development_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of four AUCs of a model, and the worse of its two transfers."""
    rows = _w(cohort(spark, sf_dir)).withColumn("role", F.col("part") % 2)
    long = reduce(DataFrame.unionByName, [rows.select("dataset", "role", F.lit(n).alias("model"), F.col(f"p_{n}").alias("p"), "target", "w") for n in ("base", "alt")])
    a = metrics.auc(long, ["model", "dataset", "role"], "target", "p", "w")
    return a.groupBy("model").agg(F.round(F.avg("auc"), 6).alias("development_score"), F.round(F.min(F.when(F.col("role") == 1, F.col("auc"))), 6).alias("min_transfer"))


@query("confusion_metrics", f"""{_W}, t AS (SELECT dataset, sum(w) FILTER (WHERE target = 1 AND p_base >= 0.5) AS tp, sum(w) FILTER (WHERE target = 0 AND p_base >= 0.5) AS fp, sum(w) FILTER (WHERE target = 1 AND p_base < 0.5) AS fn, sum(w) FILTER (WHERE target = 0 AND p_base < 0.5) AS tn FROM c GROUP BY 1)
SELECT dataset, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM t""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.rates(metrics.confusion(_w(cohort(spark, sf_dir)), ["dataset"], "target", F.col("p_base") >= 0.5, "w"))
    return t.select("dataset", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "balanced_accuracy", "f1", "mcc")])


_DOWN = f"""{_W}, s AS (SELECT dataset, p_fine AS s, sum(CASE WHEN target = 1 THEN w ELSE 0 END) AS wp, sum(CASE WHEN target = 0 THEN w ELSE 0 END) AS wn FROM c GROUP BY 1, 2),
r AS (SELECT *, sum(wp) OVER d AS tp, sum(wn) OVER d AS fp, sum(wp) OVER (PARTITION BY dataset) AS p, sum(wn) OVER (PARTITION BY dataset) AS n FROM s WINDOW d AS (PARTITION BY dataset ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


@query("average_precision", _DOWN + " SELECT dataset, round(sum(wp * tp / (tp + fp)) / max(p), 6) AS average_precision FROM r GROUP BY 1")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_w(cohort(spark, sf_dir)), ["dataset"], "target", "p_fine", "w").withColumn("average_precision", F.round("average_precision", 6))


@query("youden_threshold", _DOWN + ", k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(tp / p - fp / n, 12) DESC, s DESC) AS k FROM r) SELECT dataset, least(greatest(s, 0), 1) AS threshold FROM k WHERE k = 1")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.youden(_w(cohort(spark, sf_dir)), ["dataset"], "target", "p_fine", "w")


_CLIP = "least(greatest(p_fine, 1e-12), 1 - 1e-12)"


@query("brier_logloss", f"{_W} SELECT dataset, round(sum(w * pow(p_fine - target, 2)) / sum(w), 6) AS brier, round(sum(w * -(target * ln({_CLIP}) + (1 - target) * ln(1 - {_CLIP}))) / sum(w), 5) AS log_loss FROM c GROUP BY 1")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return _w(cohort(spark, sf_dir)).groupBy("dataset").agg(F.round(metrics.brier("target", "p_fine", w), 6).alias("brier"), F.round(metrics.log_loss("target", "p_fine", w), 5).alias("log_loss"))


_EDGES = " + ".join(f"(p_fine >= {i / 10!r})::INTEGER" for i in range(1, 10))
_BINS = f"{_W}, b AS (SELECT dataset, ({_EDGES})::INTEGER AS bin, sum(w) AS weight, sum(w * target) / sum(w) AS observed, sum(w * p_fine) / sum(w) AS predicted FROM c WHERE p_fine BETWEEN 0 AND 1 GROUP BY 1, 2)"


@query("width_bins", _BINS + " SELECT dataset, bin, round(weight, 6) AS weight, round(observed, 6) AS observed, round(predicted, 6) AS predicted FROM b")
def width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = metrics.width_bins(_w(cohort(spark, sf_dir)), ["dataset"], "target", "p_fine", F.col("w"))
    return bins.select("dataset", "bin", *[F.round(c, 6).alias(c) for c in ("weight", "observed", "predicted")])


@query("ece_equal_width", _BINS + " SELECT dataset, round(sum(weight * abs(observed - predicted)) / sum(weight), 6) AS ece FROM b GROUP BY 1")
def ece_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = metrics.width_bins(_w(cohort(spark, sf_dir)), ["dataset"], "target", "p_fine", F.col("w"))
    return metrics.ece(bins, ["dataset"]).withColumn("ece", F.round("ece", 6))


_MASS = f"{_W}, m AS (SELECT *, sum(w) OVER (PARTITION BY dataset ORDER BY p_fine, image ROWS UNBOUNDED PRECEDING) - w / 2 AS middle, sum(w) OVER (PARTITION BY dataset) AS total FROM c), b AS (SELECT *, (least(floor(round(10 * middle / total, 9)), 9) + 1)::INTEGER AS bin FROM m), r AS (SELECT dataset, bin, count(*) AS n_images, sum(w) AS weight, sum(w * p_fine) / sum(w) AS mean_prediction, sum(w * target) / sum(w) AS observed_fraction FROM b GROUP BY 1, 2)"


@query("reliability_bins", _MASS + " SELECT dataset, bin, n_images, round(weight, 6) AS weight, round(mean_prediction, 6) AS mean_prediction, round(observed_fraction, 6) AS observed_fraction, round(abs(mean_prediction - observed_fraction), 6) AS absolute_gap FROM r")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = metrics.mass_bins(_w(cohort(spark, sf_dir)), ["dataset"], "target", "p_fine", "w", ["image"])
    return bins.select("dataset", "bin", "n_images", *[F.round(c, 6).alias(c) for c in ("weight", "mean_prediction", "observed_fraction", "absolute_gap")])


@query("ece_equal_mass", _MASS + " SELECT dataset, round(sum(weight * abs(mean_prediction - observed_fraction)) / sum(weight), 6) AS ece FROM r GROUP BY 1")
def ece_equal_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = metrics.mass_bins(_w(cohort(spark, sf_dir)), ["dataset"], "target", "p_fine", "w", ["image"])
    return bins.groupBy("dataset").agg(F.round(F.sum(F.col("weight") * F.col("absolute_gap")) / F.sum("weight"), 6).alias("ece"))


@query("decision_curve", f"{_W}, t AS (SELECT round(0.10 + 0.01 * i, 2)::DOUBLE AS threshold FROM range(71) t(i)) SELECT dataset, threshold, round((sum(CASE WHEN p_fine >= threshold AND target = 1 THEN w ELSE 0 END) - sum(CASE WHEN p_fine >= threshold AND target = 0 THEN w ELSE 0 END) * threshold / (1 - threshold)) / sum(w), 6) AS net_benefit, round((sum(CASE WHEN target = 1 THEN w ELSE 0 END) - sum(CASE WHEN target = 0 THEN w ELSE 0 END) * threshold / (1 - threshold)) / sum(w), 6) AS treat_all FROM c, t GROUP BY 1, 2")
def decision_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.decision_curve(_w(cohort(spark, sf_dir)), ["dataset"], "target", "p_fine", F.col("w"))
    return curve.select("dataset", "threshold", *[F.round(c, 6).alias(c) for c in ("net_benefit", "treat_all")])


@query("benjamini_hochberg", "WITH t AS (SELECT p_brand, p_partkey, (p_retailprice - floor(p_retailprice)) / 10 + p_size / 1000.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS m FROM t) SELECT p_brand, p_partkey, round(p, 8) AS p, round(least(1, min(p * m / k) OVER (PARTITION BY p_brand ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM r")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("p_retailprice") - F.floor("p_retailprice")) / 10 + F.col("p_size") / 1000.0
    out = metrics.benjamini_hochberg(read(spark, sf_dir, "part").select("p_brand", "p_partkey", p.alias("p")), ["p_brand"], "p", ["p_partkey"])
    return out.withColumns({"p": F.round("p", 8), "q": F.round("q", 8)})


@query("error_complementarity", f"WITH {COHORT} SELECT target, count(*) FILTER (WHERE (p_base >= 0.5)::INTEGER <> target AND (p_fine >= 0.5)::INTEGER = target) AS corrected, count(*) FILTER (WHERE (p_base >= 0.5)::INTEGER = target AND (p_fine >= 0.5)::INTEGER <> target) AS worsened, count(*) AS n FROM cohort GROUP BY 1")
def error_complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = {c: (F.col(c) >= 0.5).cast("int") != F.col("target") for c in ("p_base", "p_fine")}
    return cohort(spark, sf_dir).groupBy("target").agg(F.count_if(wrong["p_base"] & ~wrong["p_fine"]).alias("corrected"), F.count_if(~wrong["p_base"] & wrong["p_fine"]).alias("worsened"), F.count(F.lit(1)).alias("n"))


@query("late_fusion_mean", f"WITH {COHORT} SELECT image, round((p_base + p_alt) / 2, 6) AS probability, round((p_base + p_alt + p_fine) / 3, 6) AS ensemble FROM cohort")
def late_fusion_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).select("image", F.round((F.col("p_base") + F.col("p_alt")) / 2, 6).alias("probability"), F.round((F.col("p_base") + F.col("p_alt") + F.col("p_fine")) / 3, 6).alias("ensemble"))


@query("decision_gates", f"{_W}, l AS (SELECT dataset, 'base' AS model, p_base AS p, target, w FROM c UNION ALL SELECT dataset, 'fine', p_fine, target, w FROM c), a AS ({_auc_sql('l', 'model, dataset', 'p', 'w')}), g AS (SELECT f.dataset, f.auc - b.auc AS delta FROM a f JOIN a b ON f.dataset = b.dataset AND f.model = 'fine' AND b.model = 'base') SELECT bool_and(delta > 0) AS supported, bool_or(delta > 0.005) AS promoted, round(min(delta), 6) AS least FROM g")
def decision_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _w(cohort(spark, sf_dir))
    a = metrics.auc(rows, ["dataset"], "target", "p_fine", "w").withColumnRenamed("auc", "f").join(metrics.auc(rows, ["dataset"], "target", "p_base", "w"), "dataset")
    delta = F.col("f") - F.col("auc")
    return a.agg(F.bool_and(delta > 0).alias("supported"), F.bool_or(delta > 0.005).alias("promoted"), F.round(F.min(delta), 6).alias("least"))


@query("transfer_matrix", f"""{_W}, p AS (SELECT *, (part % 2)::BIGINT AS domain FROM c), a AS ({_auc_sql('p', 'dataset, domain', 'p_alt', 'w')}) SELECT dataset AS source, round(max(auc) FILTER (WHERE domain = 0), 6) AS "0", round(max(auc) FILTER (WHERE domain = 1), 6) AS "1" FROM a GROUP BY 1""")
def transfer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _w(cohort(spark, sf_dir)).withColumn("domain", F.col("part") % 2)
    a = metrics.auc(rows, ["dataset", "domain"], "target", "p_alt", "w").withColumn("auc", F.round("auc", 6))
    return a.groupBy(F.col("dataset").alias("source")).pivot("domain", [0, 1]).agg(F.first("auc"))


@query("condition_deltas", f"{_W}, k AS (SELECT *, (part % 6)::BIGINT AS condition FROM c), l AS (SELECT condition, 'base' AS model, p_base AS p, target, w FROM k UNION ALL SELECT condition, 'fine', p_fine, target, w FROM k), a AS ({_auc_sql('l', 'model, condition', 'p', 'w')}), d AS (SELECT x.model, x.condition, x.auc, x.auc - clean.auc AS delta FROM a x JOIN a clean ON x.model = clean.model AND clean.condition = 0) SELECT model, round(avg(auc), 6) AS mean_auc, round(min(auc), 6) AS min_auc, round(max(auc), 6) AS max_auc, round(quantile_cont(delta, 0.5), 6) AS median_delta, round(min(delta), 6) AS worst_delta FROM d WHERE condition <> 0 GROUP BY 1")
def condition_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the AUC of each model from the clean condition to the others."""
    rows = _w(cohort(spark, sf_dir)).withColumn("condition", F.col("part") % 6)
    long = reduce(DataFrame.unionByName, [rows.select("condition", F.lit(n).alias("model"), F.col(f"p_{n}").alias("p"), "target", "w") for n in ("base", "fine")])
    a = metrics.auc(long, ["model", "condition"], "target", "p", "w")
    d = a.join(a.where("condition = 0").select("model", F.col("auc").alias("clean")), "model").where("condition <> 0").withColumn("delta", F.col("auc") - F.col("clean"))
    return d.groupBy("model").agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.min("auc"), 6).alias("min_auc"), F.round(F.max("auc"), 6).alias("max_auc"), F.round(F.percentile("delta", F.lit(0.5)), 6).alias("median_delta"), F.round(F.min("delta"), 6).alias("worst_delta"))


# ------------------------------------------------------------------ bootstrap

#: Replicates of the queries whose draws are a table, and of those that multiply matrices.
ITERATIONS, REPLICATES = 20, 2000
#: Seeds of the draws by patient and by patient and class.
SEED, UNIT_SEED = 20260717, 20260718

_DRAWS = f"""WITH {VISITS},
u AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id::VARCHAR) - 1 AS n FROM (SELECT DISTINCT patient_id FROM visits)), k AS (SELECT count(*) AS total FROM u),
m AS (SELECT i AS iteration, ('0x' || substr(md5('boot|' || i || '|' || n), 1, 15))::BIGINT % total AS n, count(*) AS m FROM u, k, range({ITERATIONS}) t(i) GROUP BY 1, 2)"""


@query("bootstrap_draws", _DRAWS + " SELECT iteration, patient_id, m FROM m JOIN u USING (n)")
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.hash_draws(resample.numbered(visits(spark, sf_dir), "patient_id"), "patient_id", ITERATIONS, "boot")


def _mix_sql(source: str, name: str) -> str:
    """The 32-bit finaliser as columns that build on each other."""
    a, b, c, d = (f"{name}_{x}" for x in "abcd")
    return f"xor({source}, {source} >> 16) AS {a}, ({a} * 2246822507::UBIGINT) % 4294967296::UBIGINT AS {b}, xor({b}, {b} >> 13) AS {c}, ({c} * 3266489909::UBIGINT) % 4294967296::UBIGINT AS {d}, xor({d}, {d} >> 16) AS {name}"


def _key_sql(value: str, factor: int, seed: int | str, name: str) -> str:
    """The hash of a number below 2**32 under a seed (a number, or a column that holds the finalised one)."""
    start = f"{int(bootstrap.finalise(np.array([seed], np.uint32))[0])}::UBIGINT" if isinstance(seed, int) else seed
    return f"(({value})::UBIGINT * {factor}::UBIGINT % 4294967296::UBIGINT + {start}) % 4294967296::UBIGINT AS {name}_s, " + _mix_sql(f"{name}_s", name)


def _multiplicities_sql(unit: str, source: str, seed: int, iterations: int = REPLICATES) -> str:
    """Tables u (unit, n) and m (iteration, n, m) of the matrix bootstrap over the units of a relation."""
    return f"""u AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}::VARCHAR) - 1 AS n FROM (SELECT DISTINCT {unit} FROM {source})),
z AS (SELECT count(*) AS total, 1 - pow(2, -greatest(0, floor(log2(greatest(sqrt(count(*)) / 6, 1))))) AS mean FROM u),
cut AS (SELECT list_filter(list_transform(range(20), lambda j: floor(4294967296.0 * list_sum(list_transform(range(j + 1), lambda i: exp(-mean) * pow(mean, i) / factorial(i::INTEGER))))::UBIGINT), lambda c: c < 4294967296) AS cuts FROM z),
turn AS (SELECT i AS iteration, {_key_sql('i', bootstrap.OF_ITERATION, seed, 'ti')}, {_key_sql('i', bootstrap.OF_ITERATION, seed + 2, 'own')}, {_mix_sql('own', 'start')} FROM range({iterations}) t(i)),
named AS (SELECT n, {_key_sql('n', bootstrap.OF_UNIT, seed + 1, 'un')} FROM u),
hashed AS (SELECT iteration, n, (ti + un) % 4294967296::UBIGINT AS tu, {_mix_sql('tu', 'h')} FROM named, turn),
poisson AS (SELECT iteration, n, len(list_filter(cuts, lambda c: c <= h)) AS m FROM hashed, cut),
missing AS (SELECT turn.iteration, start, total - coalesce(have, 0) AS more FROM turn CROSS JOIN z LEFT JOIN (SELECT iteration, sum(m) AS have FROM poisson GROUP BY 1) USING (iteration)),
dealt AS (SELECT iteration, {_key_sql('j', bootstrap.OF_DRAW, 'start', 'one')}, (one + {bootstrap.OF_DRAW}::UBIGINT) % 4294967296::UBIGINT AS next, {_mix_sql('next', 'two')} FROM (SELECT iteration, start, unnest(range(more::BIGINT)) AS j FROM missing)),
m AS (SELECT iteration, n, sum(m) AS m FROM (SELECT iteration, n, m FROM poisson WHERE m > 0 UNION ALL SELECT iteration, floor((one * 2097152::UBIGINT + (two >> 11))::DOUBLE / 9007199254740992.0 * total)::BIGINT, 1 FROM dealt, z) GROUP BY 1, 2)"""


_MATRIX = f"""WITH {VISITS}, v AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY patient_id) AS w FROM visits), {_multiplicities_sql('patient_id', 'visits', SEED)},
d AS (SELECT m.iteration, v.target, v.p_a, v.p_b, v.w * m.m AS w, v.dataset FROM m JOIN u USING (n) JOIN v USING (patient_id)),
a AS ({_auc_sql('d', 'iteration', 'p_a', 'w')}), b AS ({_auc_sql('d', 'iteration', 'p_b', 'w')})"""


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bootstrap.Draws]:
    return bootstrap.drawn(visits(spark, sf_dir), "patient_id", REPLICATES, SEED)


def _rounded(frame: DataFrame, columns: str, *first: str) -> DataFrame:
    return frame.select(*first, *[F.round(c, 6).alias(c) for c in columns.split()])


@query("bootstrap_multiplicities", f"WITH {VISITS}, {_multiplicities_sql('patient_id', 'visits', SEED)} SELECT iteration::INTEGER AS iteration, sum(m)::DOUBLE AS draws, sum(m * (n % 1000))::DOUBLE AS checked FROM m GROUP BY 1")
def bootstrap_multiplicities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every replicate draws as many patients as there are."""
    rows, draws = bootstrap.drawn(visits(spark, sf_dir).select("patient_id").distinct(), "patient_id", REPLICATES, SEED)
    return bootstrap.summed(rows.withColumns({"draws": F.lit(1.0), "checked": F.col("_number") % 1000}), draws, ["draws", "checked"])


@query("bootstrap_auc_ci", _MATRIX + " SELECT round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high, count(*) AS replicates FROM a")
def bootstrap_auc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, draws = _drawn(spark, sf_dir)
    out = resample.interval(bootstrap.replicate_auc(rows, draws, "patient_id", "target", ["p_a"]), [], "p_a")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")], "replicates")


@query("paired_delta_ci", _MATRIX + " SELECT 'p_b' AS score, round(avg(b.auc - a.auc), 6) AS mean, round(quantile_cont(b.auc - a.auc, 0.025), 6) AS ci_low, round(quantile_cont(b.auc - a.auc, 0.975), 6) AS ci_high, round(avg((b.auc > a.auc)::INTEGER), 6) AS p_positive, round(least(1, 2 * least(avg((b.auc >= a.auc)::INTEGER), avg((b.auc <= a.auc)::INTEGER))), 6) AS p_value FROM a JOIN b USING (iteration)")
def paired_delta_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, draws = _drawn(spark, sf_dir)
    out = resample.paired_intervals(bootstrap.replicate_auc(rows, draws, "patient_id", "target", ["p_a", "p_b"]), ["p_a", "p_b"], "p_a")
    return _rounded(out, "mean ci_low ci_high p_positive p_value", "score")


@query("shared_draw_degradation", _MATRIX + f", x AS ({_auc_sql('d', 'dataset, iteration', 'p_a', 'w')}), r AS (SELECT iteration, auc FROM x WHERE dataset = '1-URGENT') SELECT x.dataset, round(avg(x.auc - r.auc), 6) AS mean, round(quantile_cont(x.auc - r.auc, 0.025), 6) AS ci_low, round(quantile_cont(x.auc - r.auc, 0.975), 6) AS ci_high FROM x JOIN r USING (iteration) WHERE x.dataset <> '1-URGENT' GROUP BY 1")
def shared_draw_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the AUC between conditions when all see the same draws."""
    rows, draws = _drawn(spark, sf_dir)
    sizes = rows.groupBy("patient_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    x = bootstrap.replicate_auc(rows.join(sizes, "patient_id"), draws, "patient_id", "target", ["p_a"], ["dataset"], weight="w")
    d = x.join(x.where("dataset = '1-URGENT'").select("iteration", F.col("p_a").alias("reference")), "iteration").where("dataset <> '1-URGENT'").withColumn("delta", F.col("p_a") - F.col("reference"))
    return _rounded(resample.interval(d, ["dataset"], "delta"), "mean ci_low ci_high", "dataset")


_UNITS = "c AS (SELECT *, patient_id || '|' || target AS unit, 1.0::DOUBLE / count(*) OVER (PARTITION BY patient_id, target) AS w FROM visits)"


@query("unit_class_bootstrap", f"WITH {VISITS}, {_UNITS}, {_multiplicities_sql('unit', 'c', UNIT_SEED)}, d AS (SELECT iteration, target, p_a, w * m AS w FROM m JOIN u USING (n) JOIN c USING (unit)), a AS ({_auc_sql('d', 'iteration', 'p_a', 'w')}) SELECT round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high FROM a")
def unit_class_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that is drawn is a patient's rows of one class."""
    rows = visits(spark, sf_dir).withColumn("unit", F.concat_ws("|", F.col("patient_id").cast("string"), F.col("target").cast("string")))
    drawn, draws = bootstrap.drawn(rows, "unit", REPLICATES, UNIT_SEED)
    return _rounded(resample.interval(bootstrap.replicate_auc(drawn, draws, "unit", "target", ["p_a"]), [], "p_a"), "mean ci_low ci_high")


_PEOPLE = f"""WITH {VISITS}, p AS (SELECT patient_id, max(target) AS target, round(avg(p_a), 6) AS s FROM visits GROUP BY 1), {_multiplicities_sql('patient_id', 'p', SEED)},
d AS (SELECT iteration, target, s, m::DOUBLE AS w FROM m JOIN u USING (n) JOIN p USING (patient_id)), a AS ({_auc_sql('d', 'iteration', 's', 'w')}),
t AS (SELECT iteration, s, sum(CASE WHEN target = 1 THEN w ELSE 0 END) AS wp, sum(w) AS w FROM d GROUP BY 1, 2),
r AS (SELECT *, sum(wp) OVER o AS tp, sum(w) OVER o AS taken FROM t WINDOW o AS (PARTITION BY iteration ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT iteration, sum(wp * tp / taken) / sum(wp) AS ap FROM r GROUP BY 1)"""


@query("patient_bootstrap", _PEOPLE + " SELECT round(avg(auc), 6) AS auc, round(quantile_cont(auc, 0.025), 6) AS auc_low, round(quantile_cont(auc, 0.975), 6) AS auc_high, round(avg(ap), 6) AS ap, round(quantile_cont(ap, 0.025), 6) AS ap_low, round(quantile_cont(ap, 0.975), 6) AS ap_high, count(*) AS replicates FROM a JOIN b USING (iteration)")
def patient_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and average precision where a row is a patient."""
    people = visits(spark, sf_dir).groupBy("patient_id").agg(F.max("target").alias("target"), F.round(F.avg("p_a"), 6).alias("s")).withColumn("one", F.lit(1.0))
    rows, draws = bootstrap.drawn(people, "patient_id", REPLICATES, SEED)
    both = bootstrap.replicate_auc(rows, draws, "patient_id", "target", ["s"], weight="one").join(bootstrap.replicate_average_precision(rows, draws, "target", "s", "one"), "iteration")
    q = lambda c, at, name: F.round(F.percentile(c, F.lit(at)), 6).alias(name)
    return both.agg(F.round(F.avg("s"), 6).alias("auc"), q("s", 0.025, "auc_low"), q("s", 0.975, "auc_high"), F.round(F.avg("average_precision"), 6).alias("ap"), q("average_precision", 0.025, "ap_low"), q("average_precision", 0.975, "ap_high"), F.count(F.lit(1)).alias("replicates"))


@query("factorial_bootstrap", f"""{_MATRIX}, f AS (SELECT iteration, dataset, target, w, p_a, p_b, (p_a + p_b) / 2 AS p_full FROM d), l AS (SELECT dataset, iteration, 'p_full' AS model, p_full AS p, target, w FROM f UNION ALL SELECT dataset, iteration, 'p_a', p_a, target, w FROM f UNION ALL SELECT dataset, iteration, 'p_b', p_b, target, w FROM f),
x AS ({_auc_sql('l', 'dataset, model, iteration', 'p', 'w')}) SELECT y.dataset, y.model, round(avg(x.auc - y.auc), 6) AS mean, round(quantile_cont(x.auc - y.auc, 0.025), 6) AS ci_low, round(quantile_cont(x.auc - y.auc, 0.975), 6) AS ci_high, round(avg((x.auc > y.auc)::INTEGER), 6) AS p_positive, count(*) AS replicates, false AS failed FROM x JOIN x y ON x.dataset = y.dataset AND x.iteration = y.iteration AND x.model = 'p_full' AND y.model <> 'p_full' GROUP BY 1, 2""")
def factorial_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full model less each ablated one on every dataset under shared draws, with the audit of valid replicates."""
    rows, draws = _drawn(spark, sf_dir)
    sizes = rows.groupBy("patient_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    rows = rows.withColumn("p_full", (F.col("p_a") + F.col("p_b")) / 2).join(sizes, "patient_id")
    replicates = bootstrap.replicate_auc(rows, draws, "patient_id", "target", ["p_full", "p_a", "p_b"], ["dataset"], weight="w").checkpoint()
    table, audit = bootstrap.factorial_deltas(replicates, "p_full", ["p_a", "p_b"], ["dataset"])
    return _rounded(table, "mean ci_low ci_high p_positive", "dataset", "model").join(audit, ["dataset", "model"])


_NET = "list_sum(list_transform(range(71), lambda i: (CASE WHEN {p} >= round(0.10 + 0.01 * i, 2)::DOUBLE THEN 1 ELSE 0 END) * (CASE WHEN target = 1 THEN 1 ELSE -round(0.10 + 0.01 * i, 2)::DOUBLE / (1 - round(0.10 + 0.01 * i, 2)::DOUBLE) END))) / 71"


@query("utility_bootstrap", _MATRIX + f", g AS (SELECT patient_id, avg(pow(p_a - target, 2)) - avg(pow(p_b - target, 2)) AS brier, avg({_NET.format(p='p_a')}) - avg({_NET.format(p='p_b')}) AS net FROM visits GROUP BY 1), x AS (SELECT iteration, sum(m * brier) / sum(m) AS brier, sum(m * net) / sum(m) AS net FROM m JOIN u USING (n) JOIN g USING (patient_id) GROUP BY 1) SELECT round(avg(brier), 6) AS brier_delta, round(quantile_cont(brier, 0.025), 6) AS brier_low, round(quantile_cont(brier, 0.975), 6) AS brier_high, round(avg(net), 6) AS net_delta, round(quantile_cont(net, 0.025), 6) AS net_low, round(quantile_cont(net, 0.975), 6) AS net_high FROM x")
def utility_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visits(spark, sf_dir)
    both = resample.utility_deltas(rows, "patient_id", "target", "p_a", "p_b")
    drawn, draws = bootstrap.drawn(both, "patient_id", REPLICATES, SEED)
    x = bootstrap.summed(drawn, draws, ["brier_delta", "net_benefit_delta"])
    x = x.select("iteration", *[(F.col(c) / draws.units).alias(c) for c in ("brier_delta", "net_benefit_delta")])
    q = lambda c, at: F.round(F.percentile(c, F.lit(at)), 6)
    return x.agg(F.round(F.avg("brier_delta"), 6).alias("brier_delta"), q("brier_delta", 0.025).alias("brier_low"), q("brier_delta", 0.975).alias("brier_high"), F.round(F.avg("net_benefit_delta"), 6).alias("net_delta"), q("net_benefit_delta", 0.025).alias("net_low"), q("net_benefit_delta", 0.975).alias("net_high"))


#: The metrics of a locked evaluation that SQL has (the calibration line has a query of its own).
_LOCKED = ["group_balanced_roc_auc", "image_roc_auc", "average_precision", "balanced_accuracy", "sensitivity", "specificity", "f1", "mcc", "brier", "ece_10"]


@query("external_metrics", f"""WITH {VISITS}, v AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY patient_id) AS w, 0 AS one FROM visits), a AS ({_auc_sql('v', 'one', 'p_a', 'w')}), i AS ({_auc_sql('v', 'one', 'p_a', '1.0')}),
t AS (SELECT p_a AS s, sum(CASE WHEN target = 1 THEN w ELSE 0 END) AS wp, sum(w) AS w FROM v GROUP BY 1), r AS (SELECT *, sum(wp) OVER o AS tp, sum(w) OVER o AS taken FROM t WINDOW o AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), p AS (SELECT sum(wp * tp / taken) / sum(wp) AS ap FROM r),
c AS (SELECT sum(w) FILTER (WHERE target = 1 AND p_a >= 0.4) AS tp, sum(w) FILTER (WHERE target = 0 AND p_a >= 0.4) AS fp, sum(w) FILTER (WHERE target = 1 AND p_a < 0.4) AS fn, sum(w) FILTER (WHERE target = 0 AND p_a < 0.4) AS tn, sum(w * pow(p_a - target, 2)) / sum(w) AS brier FROM v),
b AS (SELECT least(9, floor(p_a * 10)) AS bin, sum(w) AS w, sum(w * target) / sum(w) AS o, sum(w * p_a) / sum(w) AS e FROM v GROUP BY 1), e AS (SELECT sum(w * abs(o - e)) / sum(w) AS ece FROM b)
SELECT round(a.auc, 6) AS group_balanced_roc_auc, round(i.auc, 6) AS image_roc_auc, round(ap, 6) AS average_precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(brier, 6) AS brier, round(ece, 6) AS ece_10 FROM a, i, p, c, e""")
def external_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of a locked evaluation at a threshold that was set elsewhere."""
    from lumenlake.plans.studies import external_metrics as measure

    got = measure(visits(spark, sf_dir), "p_a", 0.4)
    return spark.createDataFrame([tuple(round(float(got[c]), 6) for c in _LOCKED)], ", ".join(f"{c} double" for c in _LOCKED))


@query("calibration_line")
def calibration_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intercept and slope by Newton steps; tests hold them against a numpy solution."""
    rows = relational.share_weight(visits(spark, sf_dir), ["patient_id"], "w")
    a, b = metrics.calibration(rows, "target", "p_a", F.col("w"))
    return spark.sql(f"SELECT round({a!r}D, 6) AS intercept, round({b!r}D, 6) AS slope")


# ------------------------------------------------------------------ near duplicates and groups

_BITS = " | ".join(f"((embedding[{i + 1}] > 0)::BIGINT << {i})" for i in range(63))
#: Bits in which two sign hashes of embeddings may differ (random 64-d vectors are 31 apart).
HAMMING = 18


def _sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = [F.when(F.col("embedding")[i] > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(63)]
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits]).alias("h"))


@query("hamming_pairs", f"WITH h AS (SELECT vec_id, {_BITS} AS h FROM embeddings) SELECT a.vec_id AS first, b.vec_id AS second, bit_count(xor(a.h, b.h))::INTEGER AS hamming FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= {HAMMING}")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.hamming_pairs(_sign_hashes(spark, sf_dir), "vec_id", "h", HAMMING, 63)


@query("cross_dataset_candidates", f"WITH h AS (SELECT vec_id, label, {_BITS} AS h FROM embeddings) SELECT a.vec_id AS first, b.vec_id AS second, a.label AS dataset_first, b.label AS dataset_second, bit_count(xor(a.h, b.h))::INTEGER AS hamming, a.h = b.h AS exact FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.label <> b.label AND bit_count(xor(a.h, b.h)) <= {HAMMING}")
def cross_dataset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sign_hashes(spark, sf_dir)
    pairs = neardup.hamming_pairs(rows, "vec_id", "h", HAMMING, 63)
    named = pairs.join(rows.select(F.col("vec_id").alias("first"), F.col("label").alias("dataset_first")), "first").join(rows.select(F.col("vec_id").alias("second"), F.col("label").alias("dataset_second")), "second")
    return named.where("dataset_first <> dataset_second").select("first", "second", "dataset_first", "dataset_second", "hamming", (F.col("hamming") == 0).alias("exact"))


#: Customers with a hash of three copies of their number and their nation; the other bits are constant.
_CODED = "h AS (SELECT c_custkey, c_mktsegment, c_custkey % 2048 | ((c_custkey % 2048) << 11) | ((c_custkey % 2048) << 22) | ((c_nationkey::BIGINT) << 33) AS h FROM customer)"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long") % 2048
    h = k.bitwiseOR(F.shiftleft(k, 11)).bitwiseOR(F.shiftleft(k, 22)).bitwiseOR(F.shiftleft(F.col("c_nationkey").cast("long"), 33))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", h.alias("h"))


@query("hash_neighbours", f"WITH {_CODED} SELECT a.c_custkey AS first, b.c_custkey AS second, bit_count(xor(a.h, b.h))::INTEGER AS hamming FROM h a JOIN h b ON a.c_custkey < b.c_custkey AND bit_count(xor(a.h, b.h)) <= 5")
def hash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs at the distance of the image audits, of hashes with constant bits."""
    return neardup.hamming_pairs(_coded(spark, sf_dir), "c_custkey", "h", 5)


@query("hash_candidates_across", f"WITH {_CODED} SELECT a.c_custkey AS first, b.c_custkey AS second, a.c_mktsegment AS dataset_first, b.c_mktsegment AS dataset_second, bit_count(xor(a.h, b.h))::INTEGER AS hamming FROM h a JOIN h b ON a.c_custkey < b.c_custkey AND a.c_mktsegment <> b.c_mktsegment AND bit_count(xor(a.h, b.h)) <= 4")
def hash_candidates_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different datasets at the distance of their audit."""
    rows = _coded(spark, sf_dir)
    pairs = neardup.hamming_pairs(rows, "c_custkey", "h", 4)
    side = lambda n: rows.select(F.col("c_custkey").alias(n), F.col("c_mktsegment").alias(f"dataset_{n}"))
    return pairs.join(side("first"), "first").join(side("second"), "second").where("dataset_first <> dataset_second").select("first", "second", "dataset_first", "dataset_second", "hamming")


_GROUPS = f"""WITH RECURSIVE h AS (SELECT vec_id, label, {_BITS} AS h FROM embeddings), e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM h a JOIN h b ON a.vec_id <> b.vec_id AND bit_count(xor(a.h, b.h)) <= {HAMMING}),
reach AS (SELECT vec_id AS root, vec_id AS node FROM h UNION SELECT reach.root, e.y FROM reach JOIN e ON e.x = reach.node), l AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)"""


@query("connected_components", _GROUPS + " SELECT node, root FROM l")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sign_hashes(spark, sf_dir)
    edges = neardup.hamming_pairs(rows, "vec_id", "h", HAMMING, 63)
    return neardup.component_labels(rows.select(F.col("vec_id").alias("node")), edges)


@query("visual_groups", _GROUPS + ", g AS (SELECT root, count(*) AS group_size, count(DISTINCT label) > 1 AS conflict FROM l JOIN h ON h.vec_id = l.node GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY root::VARCHAR) AS k FROM g) SELECT node, 'visual_group_' || lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INTEGER, '0') AS group_id, group_size, conflict AS cross_label_conflict, NOT conflict AS is_valid FROM l JOIN o USING (root)")
def visual_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sign_hashes(spark, sf_dir)
    labels = neardup.component_labels(rows.select(F.col("vec_id").alias("node")), neardup.hamming_pairs(rows, "vec_id", "h", HAMMING, 63))
    return neardup.visual_groups(labels, rows.select(F.col("vec_id").alias("node"), "label"), "label")
