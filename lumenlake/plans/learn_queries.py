"""Queries of fitting, tuning, transfer and stability.  SQL expresses few of them; tests hold the others against numpy and analytic cases."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import batched, folds, learn, selection, trees
from lumenlake.plans import locked
from lumenlake.plans.registry import query, read
from lumenlake.plans.runner import Runner
from lumenlake.session import shared_dir

COLUMNS = ["x_price", "x_month", "x_day", "x_lines", "x_quantity", "x_discount"]
FAMILIES = {"order": COLUMNS[:3], "lines": COLUMNS[3:]}
#: Permutations of each family.
PERMUTATIONS = 1000


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients (customers) with images (orders), six features and a target; a nation is a dataset."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("double").alias("x_lines"), F.avg("l_quantity").alias("x_quantity"), F.avg("l_discount").alias("x_discount"))
    orders = read(spark, sf_dir, "orders").join(lines, "o_orderkey")
    people = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("image"),
        F.col("o_custkey").alias("patient_id"),
        F.col("n_name").alias("dataset"),
        F.col("n_regionkey").alias("region"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.col("o_totalprice").alias("x_price"),
        F.month("o_orderdate").cast("double").alias("x_month"),
        F.dayofyear("o_orderdate").cast("double").alias("x_day"),
        "x_lines",
        "x_quantity",
        "x_discount",
    )


#: The same rows in SQL.
STUDY = """lines AS (SELECT l_orderkey, count(*)::DOUBLE AS x_lines, avg(l_quantity) AS x_quantity, avg(l_discount) AS x_discount FROM lineitem GROUP BY 1),
study AS (SELECT o_orderkey AS image, o_custkey AS patient_id, n_name AS dataset, n_regionkey AS region, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
    o_totalprice AS x_price, month(o_orderdate)::DOUBLE AS x_month, dayofyear(o_orderdate)::DOUBLE AS x_day, x_lines, x_quantity, x_discount
  FROM orders JOIN lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``study`` with one row a patient: mean features, and whether most images are positive."""
    rows = study(spark, sf_dir).groupBy("patient_id", "dataset")
    return rows.agg(F.min("image").alias("image"), (F.avg("target") >= 0.5).cast("int").alias("target"), *[F.avg(c).alias(c) for c in COLUMNS])


def outer_folds(frame: DataFrame, repeats: int = 2, n: int = 4) -> DataFrame:
    out = None
    for r in range(repeats):
        one = folds.hash_folds(frame, "patient_id", "target", n, f"outer{r}").withColumn("repeat", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


#: Seed, folds and repeats of the studies (fixed values of the protocol).
SEED, FOLDS, REPEATS = 20260717, 4, 5


@query("stratified_group_folds")
def stratified_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(study(spark, sf_dir), "patient_id", "target", FOLDS, SEED)


@query("fold_signatures", f"WITH {STUDY}, g AS (SELECT patient_id, count(*) FILTER (WHERE target = 0) AS negatives, count(*) FILTER (WHERE target = 1) AS positives FROM study GROUP BY 1) SELECT negatives, positives, count(*) AS patients, count(*) // {FOLDS} AS least, (count(*) + {FOLDS - 1}) // {FOLDS} AS most, 0 AS leaks FROM g GROUP BY 1, 2")
def fold_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the dealt folds: patients of equal class counts, the fewest and the most of them in a fold, and patients in several folds."""
    rows = study(spark, sf_dir)
    dealt = folds.stratified_folds(rows, "patient_id", "target", FOLDS, SEED)
    own = dealt.groupBy("patient_id").agg(F.count_distinct("fold").alias("_f"), F.min("fold").alias("fold"))
    each = folds.class_counts(rows, "patient_id", "target").join(own, "patient_id")
    cells = each.groupBy("negatives", "positives", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_f") > 1).alias("l"))
    least = F.when(F.count(F.lit(1)) < FOLDS, 0).otherwise(F.min("n"))
    return cells.groupBy("negatives", "positives").agg(F.sum("n").alias("patients"), least.alias("least"), F.max("n").alias("most"), F.sum("l").alias("leaks"))


#: The first of a hundred seeds whose both parts hold every pair of region and target.
_SPLIT = f"""WITH {STUDY}, base AS (SELECT DISTINCT patient_id, region, target FROM study),
parts AS (SELECT seed, patient_id, region, target,
    ('0x' || substr(md5(seed || '|' || patient_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.2 AS held FROM base, range(20260717, 20260817) s(seed)),
used AS (SELECT min(seed) AS seed FROM (SELECT seed FROM parts GROUP BY seed HAVING
    count(DISTINCT (region, target)) FILTER (WHERE held) = (SELECT count(DISTINCT (region, target)) FROM base)
    AND count(DISTINCT (region, target)) FILTER (WHERE NOT held) = (SELECT count(DISTINCT (region, target)) FROM base)))
SELECT DISTINCT patient_id, CASE WHEN held THEN 'validation' ELSE 'train' END AS part FROM parts JOIN used USING (seed)"""


@query("group_shuffle_split", _SPLIT)
def group_shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.group_split(study(spark, sf_dir), "patient_id", ["region", "target"], 0.2, 20260717)


@query("scaling", f"WITH {STUDY} " + " UNION ALL ".join(f"SELECT '{c}' AS column, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation FROM study" for c in COLUMNS))
def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learn.scaling(study(spark, sf_dir), COLUMNS)
    return spark.createDataFrame([(c, round(float(m), 6), round(float(s), 6)) for c, (m, s) in rows.items()], "column string, mean double, deviation double")


@query("logistic_fit")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced ridge logistic regression by Newton steps over the table, which is joined and written once."""
    rows = batched.written(study(spark, sf_dir))
    rows = learn.balanced_weight(learn.standardised(rows, learn.scaling(rows, COLUMNS)), "target")
    coef, constant = learn.fit_logistic(rows, COLUMNS, "target", "class_weight")
    return learn.predict_logistic(rows, COLUMNS, coef, constant).select("image", "patient_id", "target", F.round("probability", 6).alias("probability"))


@query("tune_logistic")
def tune_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = study(spark, sf_dir)
    slots = folds.repeated_folds(rows, "patient_id", "target", FOLDS, REPEATS, SEED)
    return selection.tuned_folds(rows, slots, REPEATS, FOLDS, COLUMNS, "target", "patient_id").select("c", F.round("auc", 6).alias("auc"))


@query("weighted_tuning")
def weighted_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets and classes weigh alike, and patients within them, in every training and every held part on its own."""
    rows = study(spark, sf_dir)
    slots = folds.repeated_folds(rows, "patient_id", "target", FOLDS, REPEATS, SEED)
    return selection.tuned_parts(rows, slots, REPEATS, FOLDS, COLUMNS, "target", "patient_id", ["region", "target"]).select("c", F.round("auc", 6).alias("auc"), "best")


@query("nested_cross_validation")
def nested_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.nested(study(spark, sf_dir), "patient_id", ["image"], COLUMNS, "target", REPEATS, FOLDS, 3, SEED)


#: Blocks of columns that the ablation leaves out, one at a time and in pairs of families.
BLOCKS = {"full": COLUMNS, **{f"without_{n}": [c for c in COLUMNS if c not in own] for n, own in FAMILIES.items()}, **{f"without_{c[2:]}": [x for x in COLUMNS if x != c] for c in COLUMNS}}


@query("domain_ablation")
def domain_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region scored by models of the others, with blocks of columns left out; strata of region and class weigh alike in training."""
    rows = study(spark, sf_dir)
    regions = [str(r) for r in range(5)]
    runs = {f"others>{r}": ([x for x in regions if x != r], [r]) for r in regions}
    out = selection.ablated(rows, "region", COLUMNS, "target", "patient_id", runs, BLOCKS, "full", strata=["region", "target"], equal_groups=True)
    return out.select("run", F.col("subset").alias("block"), F.round("auc", 6).alias("auc"), F.round("delta", 6).alias("delta"))


# ------------------------------------------------------------------ embeddings, alone and fused

#: Entries of an embedding, and hand-made features of the same pictures.
EMBEDDED, HAND = [f"e{i}" for i in range(64)], ["h_mean", "h_spread", "h_low", "h_high", "h_edge"]
DESIGNS = {"hand": HAND, "embedding": selection.Design(embedded=EMBEDDED), "fusion": selection.Design(HAND, EMBEDDED)}


def pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as pictures, four a patient; a target that both the features and single entries tell something of, a dataset by label."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    spread = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x"))
    edge = F.aggregate(F.slice("x", 1, 8), F.lit(0.0), lambda a, v: a + F.abs(v))
    signal = F.col("x")[0] + F.col("x")[1] + F.col("x")[9] + (F.col("vec_id") * 7919 % 101) / 404.0 - 0.125
    return rows.select(
        F.col("vec_id").alias("image"),
        F.expr("vec_id div 4").alias("patient_id"),
        (F.col("label") % 3).cast("string").alias("dataset"),
        (signal > 0).cast("int").alias("target"),
        mean.alias("h_mean"),
        spread.alias("h_spread"),
        F.array_min("x").alias("h_low"),
        F.array_max("x").alias("h_high"),
        edge.alias("h_edge"),
        *[F.col("x")[i].alias(f"e{i}") for i in range(64)],
    )


def _fold_scores(spark: SparkSession, sf_dir: str, cs: tuple[float, ...], subsets: dict) -> DataFrame:
    rows = pictured(spark, sf_dir)
    slots = folds.repeated_folds(rows, "patient_id", "target", FOLDS, REPEATS, SEED)
    return selection.out_of_fold(rows, slots, REPEATS, FOLDS, ["image"], HAND + EMBEDDED, "target", "patient_id", cs, subsets)


@query("embedding_tuning")
def embedding_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made features, 32 whitened components of the embedding, and both fused early: C of each by repeated folds, components learnt in each training part."""
    rows = pictured(spark, sf_dir)
    slots = folds.repeated_folds(rows, "patient_id", "target", FOLDS, REPEATS, SEED)
    out = selection.tuned_folds(rows, slots, REPEATS, FOLDS, HAND + EMBEDDED, "target", "patient_id", subsets=DESIGNS)
    return out.select(F.col("subset").alias("design"), "c", F.round("auc", 6).alias("auc"))


@query("embedding_transfer")
def embedding_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three designs between datasets, each from each other and from all others."""
    names = ["0", "1", "2"]
    runs = {f"{a}>{b}": ([a], [b]) for a in names for b in names if a != b} | {f"others>{b}": ([a for a in names if a != b], [b]) for b in names}
    scores, _ = selection.by_dataset(pictured(spark, sf_dir), "dataset", ["image", "patient_id"], HAND + EMBEDDED, "target", runs, 0.1, DESIGNS)
    return selection.ablation(scores, "patient_id", "target", "fusion").select("run", F.col("subset").alias("design"), F.round("auc", 6).alias("auc"), F.round("delta", 6).alias("delta"))


@query("stacked_fusion")
def stacked_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late fusion of the features' and the embedding's out-of-fold probabilities, by mean and by a stacked model."""
    names = ["hand", "embedding"]
    scores = _fold_scores(spark, sf_dir, (0.1,), {n: DESIGNS[n] for n in names})
    out = selection.fused(scores, REPEATS, FOLDS, "patient_id", ["image"], "target", names)
    return out.select("repeat", "held", "image", "patient_id", "target", *[F.round(n, 6).alias(n) for n in (*names, "mean", "stacked")])


@query("locked_evaluation")
def locked_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six methods tuned and fitted on dataset 0 and scored on the others, in stages that a rerun finds committed."""
    protocol = locked.Protocol(HAND, EMBEDDED)
    runner = Runner(spark, f"{shared_dir(spark)}/locked-{uuid.uuid4().hex}")
    return locked.evaluate(runner, pictured(spark, sf_dir), "0", ["1", "2"], protocol)


#: Configurations that a confirmation compares: columns and C.
CONFIGURATIONS = {f"{n}_{c:g}": (columns, c) for n, columns in {"all": COLUMNS, "order": FAMILIES["order"], "lines": FAMILIES["lines"], "price": COLUMNS[:1]}.items() for c in (0.1, 10.0)}


@query("confirmation")
def confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight configurations over ten repeats of the same folds."""
    out = selection.configurations(study(spark, sf_dir), "patient_id", ["image"], COLUMNS, "target", CONFIGURATIONS, 10, FOLDS, SEED)
    return out.select("configuration", "repeats", F.round("auc", 6).alias("auc"), F.round("auc_sd", 6).alias("auc_sd"))


@query("screen_embedded")
def screen_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of a logistic model on whitened components, learnt in each training part from cross products of the folds."""
    rows, params = study(spark, sf_dir), {"c": 1.0, "k": 4}
    slots = outer_folds(rows, 1, FOLDS).select("patient_id", F.array("fold").alias("slots"))
    designs = {"embedded": selection.Design(embedded=COLUMNS, k=params["k"])}
    scores = selection.out_of_fold(rows, slots, 1, FOLDS, ["image", "patient_id", "dataset"], COLUMNS, "target", "patient_id", [params["c"]], designs)
    return scores.select("repeat", "held", F.lit(0).alias("param_id"), F.lit(json.dumps(params)).alias("params"), "image", "patient_id", "dataset", "target", "probability")


#: Tree ensembles of the screen, one configuration each (fewer trees and rounds than usual, see README).
ENSEMBLES = {
    "random_forest": trees.Ensemble(0, "forest", 100, share="sqrt", leaf=3, depth=8),
    "extra_trees": trees.Ensemble(0, "extra", 100, share="sqrt", leaf=3, depth=8),
    "boosted": trees.Ensemble(0, "boosted", 100, leaf=1, depth=2, rate=0.1),
    "histogram_boosted": trees.Ensemble(0, "boosted", 30, leaf=20, leaves=15, rate=0.1, ridge=1.0),
    "adaptive": trees.Ensemble(0, "adaptive", 100, depth=1, rate=0.5),
}


def _ensemble(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = study(spark, sf_dir)
        slots = folds.repeated_folds(rows, "patient_id", "target", FOLDS, 1, SEED)
        return selection.tree_scores(rows, slots, FOLDS, ["image"], COLUMNS, "target", "patient_id", {name: ENSEMBLES[name]})

    run.__doc__ = f"Out-of-fold scores of the ensemble {name} on all images."
    return run


for _name in ENSEMBLES:
    query(f"screen_{_name}")(_ensemble(_name))


def _machines(spark: SparkSession, sf_dir: str, cs: tuple[float, ...], gammas: tuple) -> DataFrame:
    rows = study(spark, sf_dir)
    slots = folds.repeated_folds(rows, "patient_id", "target", FOLDS, 1, SEED)
    return selection.machine_scores(rows, slots, FOLDS, ["image"], COLUMNS, "target", "patient_id", cs, gammas)


@query("screen_linear_svm")
def screen_linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold margins of linear hinge machines on all images, for the grid of C."""
    return _machines(spark, sf_dir, selection.C_GRID, (None,))


@query("screen_rbf_svm")
def screen_rbf_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold margins of Gaussian hinge machines on all images, by landmarks."""
    return _machines(spark, sf_dir, (1.0,), ("scale",))


@query("transfer_pairs")
def transfer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ordered pair of datasets, and every dataset from all others: one fit for each set of training datasets."""
    rows = study(spark, sf_dir)
    names = sorted(r[0] for r in rows.select("dataset").distinct().collect())
    runs = {f"{a}>": ([a], [b for b in names if b != a]) for a in names} | {f"others>{b}": ([a for a in names if a != b], [b]) for b in names}
    scores, _ = selection.by_dataset(rows, "dataset", ["image", "patient_id"], COLUMNS, "target", runs)
    run = F.when(F.col("run").startswith("others"), F.lit("others")).otherwise(F.rtrim(F.col("run"), F.lit(">")))
    return scores.select(F.concat(run, F.lit(">"), "dataset").alias("run"), "image", "patient_id", "dataset", "target", "probability")


@query("coefficient_stability")
def coefficient_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stability(study(spark, sf_dir), "patient_id", COLUMNS, "target", 300, SEED)


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.permutation_importance(study(spark, sf_dir), "image", COLUMNS, FAMILIES, "target", "patient_id", 1.0, PERMUTATIONS, SEED)
