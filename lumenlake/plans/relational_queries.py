"""Queries of the relational operators: projection, filters, joins, aggregates, weights, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.operators import folds, relational, resample
from lumenlake.plans.registry import query, read
from lumenlake.plans.views import COHORT, VISITS, cohort, visits

# ------------------------------------------------------------------ projection, filter, scalars


@query("prefix_projection", "SELECT l_orderkey, l_linenumber, l_quantity AS basic_quantity, l_extendedprice AS basic_price, l_discount AS fractal_discount, l_tax AS zone_tax FROM lineitem")
def prefix_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("basic_quantity"), F.col("l_extendedprice").alias("basic_price"), F.col("l_discount").alias("fractal_discount"), F.col("l_tax").alias("zone_tax"), F.lit(1).alias("other"))
    families = ("basic_", "fractal_", "zone_")
    return wide.select("l_orderkey", "l_linenumber", *[c for p in families for c in wide.columns if c.startswith(p)])


@query("column_family", """SELECT event_type, CASE WHEN starts_with(event_type, 'v') THEN 'basic' WHEN starts_with(event_type, 'c') THEN 'fractal' WHEN starts_with(event_type, 'e') THEN 'extrema' WHEN starts_with(event_type, 's') THEN 'wavelet' ELSE 'shape' END AS family, count(*) AS n FROM events GROUP BY 1, 2""")
def column_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = relational.family(F.col("event_type"), {"v": "basic", "c": "fractal", "e": "extrema", "s": "wavelet", "p": "shape"})
    return read(spark, sf_dir, "events").withColumn("family", family).groupBy("event_type", "family").agg(F.count(F.lit(1)).alias("n"))


@query("bool_parse_filter", "SELECT event_id, user_id, value FROM events WHERE lower(CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'Yes' WHEN 3 THEN 'no' ELSE 'False' END) IN ('true', '1', 'yes')")
def bool_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.element_at(F.array(*map(F.lit, ("TRUE", "1", "Yes", "no", "False"))), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").where(relational.truthy(flag)).select("event_id", "user_id", "value")


@query("conditional_eligibility", "SELECT count(*) AS eligible, count(DISTINCT o_custkey) AS patients FROM orders WHERE o_orderstatus = 'F'")
def conditional_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag columns count only where a table has them and they are not all null."""
    rows = read(spark, sf_dir, "orders").withColumns({"accepted": F.lit(None).cast("string"), "is_clean_primary": (F.col("o_orderstatus") == "F").cast("string")})
    used = rows.agg(*[F.count(c).alias(c) for c in ("accepted", "is_clean_primary")]).first().asDict()
    for c, n in used.items():
        rows = rows.where(relational.truthy(c)) if n else rows
    return rows.agg(F.count(F.lit(1)).alias("eligible"), F.count_distinct("o_custkey").alias("patients"))


@query("derived_keys", "SELECT p_partkey, split_part(p_name, ' ', 1) AS patient, p_brand || '::' || split_part(p_name, ' ', 1) AS domain_group, concat_ws('|', split_part(p_name, ' ', 1), (CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::VARCHAR) AS unit, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS target FROM part")
def derived_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    patient = F.split_part("p_name", F.lit(" "), F.lit(1))
    target = F.when(F.col("p_size") > 25, 1).otherwise(0)
    return read(spark, sf_dir, "part").select("p_partkey", patient.alias("patient"), F.concat_ws("::", "p_brand", patient).alias("domain_group"), F.concat_ws("|", patient, target.cast("string")).alias("unit"), target.alias("target"))


@query("label_from_prefix", "SELECT event_id, CASE WHEN starts_with(lower(event_type || '_' || event_id), 'view_') THEN 'view' WHEN starts_with(lower(event_type || '_' || event_id), 'click_') THEN 'click' ELSE 'unknown' END AS label FROM events")
def label_from_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", "event_type", F.col("event_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", relational.label_from_prefix(name, ("view", "click")).alias("label"))


@query("string_normalise", "SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS segment, replace(c_name, 'Customer#', '') AS number, replace(lower(c_mktsegment), 'e', '|') AS barred, length(c_name) AS name_length FROM customer")
def string_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.lower(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))).alias("segment"), F.replace("c_name", F.lit("Customer#"), F.lit("")).alias("number"), F.replace(F.lower("c_mktsegment"), F.lit("e"), F.lit("|")).alias("barred"), F.length("c_name").cast("long").alias("name_length"))


@query("membership_filter", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE lower(substr(o_orderpriority, 1, 1)) IN ('3', '4') GROUP BY 1")
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(F.lower(F.substring("o_orderpriority", 1, 1)).isin("3", "4")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("exclusion_reason_cascade", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'missing_image' WHEN l_discount = 0 THEN 'missing_mask' WHEN l_returnflag = 'A' THEN 'unsupported_label' WHEN l_tax > 0.07 THEN 'geometry_mismatch' WHEN l_extendedprice < 2000 THEN 'empty_mask' ELSE '' END AS exclusion_reason FROM lineitem")
def exclusion_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("missing_image", F.col("l_quantity") < 5), ("missing_mask", F.col("l_discount") == 0), ("unsupported_label", F.col("l_returnflag") == "A"), ("geometry_mismatch", F.col("l_tax") > 0.07), ("empty_mask", F.col("l_extendedprice") < 2000)]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", relational.first_reason(rules).alias("exclusion_reason"))


@query("validity_conjunction", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 3 AND NOT l_discount > 0.08 AND NOT l_tax = 0 AND l_returnflag <> 'A' AND l_extendedprice > 1000) AS clean, count(*) AS n FROM lineitem GROUP BY 1")
def validity_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = (F.col("l_quantity") > 3) & ~(F.col("l_discount") > 0.08) & ~(F.col("l_tax") == 0) & (F.col("l_returnflag") != "A") & (F.col("l_extendedprice") > 1000)
    return read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(clean).alias("clean"), F.count(F.lit(1)).alias("n"))


@query("rename_clip", "SELECT o_orderkey AS image, least(greatest(o_totalprice / 300000, 1e-6), 1 - 1e-6) AS probability, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, '') AS status FROM orders")
def rename_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.least(F.greatest(F.col("o_totalprice") / 300000, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("probability"), F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("")).alias("status"))


@query("math_scalars", "SELECT p_partkey, round(ln(p_retailprice), 6) AS ln_p, round(ln(1 + p_size), 6) AS log1p_s, round(log2(p_retailprice), 6) AS log2_p, round(exp(p_size / 50.0::DOUBLE), 6) AS exp_s, round(sqrt(p_retailprice), 6) AS sqrt_p, abs(p_size - 25)::INTEGER AS abs_s, sign(p_size - 25)::DOUBLE AS sign_s, round(pow(p_size, 1.5), 6) AS pow_s, ceil(p_retailprice)::BIGINT AS ceil_p, round(atan2(sin(p_size * 0.5), cos(p_size * 0.5)), 6) AS wrapped FROM part")
def math_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(F.log(p), 6).alias("ln_p"), F.round(F.log1p(s), 6).alias("log1p_s"), F.round(F.log2(p), 6).alias("log2_p"), F.round(F.exp(s / 50.0), 6).alias("exp_s"), F.round(F.sqrt(p), 6).alias("sqrt_p"), F.abs(s - 25).alias("abs_s"), F.signum(s - 25).alias("sign_s"), F.round(F.pow(s, F.lit(1.5)), 6).alias("pow_s"), F.ceil(p).alias("ceil_p"), F.round(relational.wrapped_angle(s * 0.5), 6).alias("wrapped"))


_LITTLE = " + ".join(f"('0x' || substr(h, {2 * i + 1}, 2))::HUGEINT * {256**i}::HUGEINT" for i in range(8))


@query("hash_scalars", f"WITH d AS (SELECT c_custkey, c_name, sha256('7|' || c_name) AS h FROM customer) SELECT c_custkey, sha256(c_name) AS sha, md5(c_name) AS md, (({_LITTLE}) % 4294967295)::BIGINT AS seed FROM d")
def hash_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("sha"), F.md5(F.col("c_name").cast("binary")).alias("md"), relational.hash_seed(F.lit("7"), F.col("c_name")).alias("seed"))


@query("finite_guard", "SELECT count(*) FILTER (WHERE NOT isfinite(l_quantity)) AS l_quantity, count(*) FILTER (WHERE NOT isfinite(l_tax / nullif(l_discount, 0)) OR l_discount = 0) AS ratio FROM lineitem")
def finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("ratio", F.try_divide("l_tax", "l_discount"))
    return relational.nonfinite_counts(rows, ["l_quantity", "ratio"])


# ------------------------------------------------------------------ joins


@query("one_to_one_join", "SELECT o.o_orderkey, o.o_totalprice, l.revenue FROM orders o JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return relational.join_one_to_one(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), sums, ["o_orderkey"])


@query("aligned_predictions", f"WITH {COHORT}, m AS (SELECT patient_id, dataset, round(avg(p_base), 6) AS base, round(avg(p_alt), 6) AS alt, round(avg(p_fine), 6) AS fine FROM cohort GROUP BY 1, 2) SELECT patient_id, dataset, base, alt, fine FROM m")
def aligned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir)
    sides = {n: rows.groupBy("patient_id", "dataset").agg(F.round(F.avg(f"p_{n}"), 6).alias("v")) for n in ("base", "alt", "fine")}
    return relational.align(sides, ["patient_id", "dataset"], "v")


@query("left_interval_join", "SELECT n.n_name, n.n_regionkey, s.low, s.high FROM nation n LEFT JOIN (SELECT s_nationkey, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON n.n_nationkey = s.s_nationkey")
def left_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    return relational.join_one_to_one(read(spark, sf_dir, "nation"), ends, ["n_nationkey"], "left").select("n_name", "n_regionkey", "low", "high")


@query("anti_join_missing", "SELECT c_custkey AS custkey, 'left' AS found_in FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return relational.only_in(a, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("dictionary_join", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups in tables of 25 and 5 rows, which stay that size at any scale."""
    places = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("key_concat", "SELECT p.p_partkey, p.p_size, q.sold FROM part p JOIN (SELECT l_partkey, round(sum(l_quantity), 2) AS sold FROM lineitem GROUP BY 1) q ON p.p_partkey = q.l_partkey")
def key_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables side by side: by key, never by position."""
    sold = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.sum("l_quantity"), 2).alias("sold"))
    return read(spark, sf_dir, "part").select("p_partkey", "p_size").join(sold, "p_partkey")


@query("alignment_check", "(SELECT o_custkey AS custkey, 'left' AS found_in FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 100000)) UNION ALL (SELECT o_custkey, 'right' FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    return relational.misaligned(rows.where("o_orderstatus = 'F'"), rows.where("o_totalprice > 100000"), ["custkey"])


# ------------------------------------------------------------------ aggregates


@query("mean_over_repeats", f"WITH {COHORT} SELECT patient_id, label, target, round(avg(p_base), 6) AS probability, count(*) AS n FROM cohort GROUP BY 1, 2, 3")
def mean_over_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).groupBy("patient_id", "label", "target").agg(F.round(F.avg("p_base"), 6).alias("probability"), F.count(F.lit(1)).alias("n"))


def _collapse(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = cohort(spark, sf_dir).withColumn("target", F.max("target").over(Window.partitionBy("patient_id"))).withColumn("label", F.when(F.col("target") == 1, "malignant").otherwise("benign"))
        return relational.collapse(rows, "patient_id", "label", "target", "p_fine", how).withColumn("p_fine", F.round("p_fine", 6))

    return run


for _how, _sql in (("mean", "avg(p_fine)"), ("median", "quantile_cont(p_fine, 0.5)")):
    query(f"patient_collapse_{_how}", f"WITH {COHORT} SELECT patient_id, CASE WHEN max(target) = 1 THEN 'malignant' ELSE 'benign' END AS label, max(target) AS target, count(*) AS n_rows, round({_sql}, 6) AS p_fine FROM cohort GROUP BY 1")(_collapse(_how))


@query("seed_named_agg", "SELECT l_shipdate::DATE::VARCHAR AS day, round(avg(l_discount), 6) AS mean, min(l_discount) AS low, max(l_discount) AS high, count(DISTINCT l_suppkey) AS seeds, min(l_returnflag) AS first_flag FROM lineitem GROUP BY 1")
def seed_named_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.count_distinct("l_suppkey").alias("seeds"), F.min("l_returnflag").alias("first_flag"))


@query("value_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS patients FROM lineitem GROUP BY 1, 2")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("patients"))


@query("patient_summary", f"WITH {COHORT} SELECT patient_id, count(*) AS images, count(*) FILTER (WHERE target = 0) AS benign, count(*) FILTER (WHERE target = 1) AS malignant, min(target) <> max(target) AS mixed FROM cohort GROUP BY 1")
def patient_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).groupBy("patient_id").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("target") == 0).alias("benign"), F.count_if(F.col("target") == 1).alias("malignant"), (F.min("target") != F.max("target")).alias("mixed"))


@query("exact_duplicate_groups", "SELECT sha256(text) AS digest, count(*) AS n, string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id::VARCHAR) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return relational.repeated(rows, "digest", "doc_id")


@query("cross_source_overlap", "SELECT sha256(text) AS digest, string_agg(DISTINCT source, '|' ORDER BY source) AS datasets, count(*) AS n, string_agg(source || ':' || doc_id, '|' ORDER BY source || ':' || doc_id) AS members FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return relational.shared_between(rows, "digest", "source", "doc_id")


@query("pivot_predictions", f"WITH {COHORT} SELECT part, round(avg(CASE WHEN dataset = 'F' THEN p_base END), 6) AS \"probability_F\", round(avg(CASE WHEN dataset = 'O' THEN p_base END), 6) AS \"probability_O\" FROM cohort GROUP BY 1")
def pivot_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.wide(cohort(spark, sf_dir), ["part"], "dataset", ["F", "O"], "p_base")
    return out.withColumns({c: F.round(c, 6) for c in ("probability_F", "probability_O")})


@query("block_means", "SELECT p_brand, round(avg(p_retailprice), 4) AS mean, min(p_retailprice) AS least FROM part GROUP BY 1")
def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"), F.min("p_retailprice").alias("least"))


@query("runtime_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def runtime_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS mean_discount FROM lineitem GROUP BY 1")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 8).alias("mean_discount"))


@query("subgroup_size_rule", f"WITH {VISITS} SELECT dataset, count(*) AS n, count(*) FILTER (WHERE target = 1) AS positives FROM visits GROUP BY 1 HAVING count(*) >= 100 AND count(*) FILTER (WHERE target = 1) >= 20 AND count(*) FILTER (WHERE target = 0) >= 20")
def subgroup_size_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visits(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == 1).alias("positives"))
    return rows.where("n >= 100 AND positives >= 20 AND n - positives >= 20")


@query("vector_correlation", "SELECT a.vec_id AS first, b.vec_id AS second, round((SELECT corr(x, y) FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y)), 6) AS correlation FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    pairs = rows.select(F.col("vec_id").alias("first"), F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("first"), F.col("vec_id").alias("second"), F.col("embedding").alias("b")), "first")
    each = pairs.select("first", "second", F.explode(F.arrays_zip("a", "b")).alias("z"))
    return each.groupBy("first", "second").agg(F.round(F.corr(F.col("z.a").cast("double"), F.col("z.b").cast("double")), 6).alias("correlation"))


@query("cohort_summary", "SELECT source, count(*) AS total, count(*) FILTER (WHERE n_chars >= 200) AS accepted, count(*) FILTER (WHERE n_chars < 200) AS excluded, count(DISTINCT lang) AS groups, string_agg(DISTINCT lang, '|' ORDER BY lang) AS devices FROM documents GROUP BY 1")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") >= 200).alias("accepted"), F.count_if(F.col("n_chars") < 200).alias("excluded"), F.count_distinct("lang").alias("groups"), F.array_join(F.sort_array(F.collect_set("lang")), "|").alias("devices"))


# ------------------------------------------------------------------ weights and windows


@query("patient_equal_weight", f"WITH {COHORT} SELECT image, round(1.0 / count(*) OVER (PARTITION BY patient_id), 9) AS weight FROM cohort")
def patient_equal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.share_weight(cohort(spark, sf_dir), ["patient_id"]).select("image", F.round("weight", 9).alias("weight"))


@query("patient_class_weight", f"WITH {COHORT} SELECT image, round(1.0 / count(*) OVER (PARTITION BY patient_id, target), 9) AS weight FROM cohort")
def patient_class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.share_weight(cohort(spark, sf_dir), ["patient_id", "target"]).select("image", F.round("weight", 9).alias("weight"))


@query("normalised_group_weight", f"WITH {COHORT}, w AS (SELECT image, patient_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY patient_id) AS w FROM cohort), t AS (SELECT count(DISTINCT patient_id) AS g, sum(w) AS s FROM w) SELECT image, round(w * g / s, 9) AS weight FROM w, t")
def normalised_group_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.normalised_weight(cohort(spark, sf_dir), "patient_id").select("image", F.round("weight", 9).alias("weight"))


_STRATUM = f"""WITH {VISITS}, s AS (SELECT dataset, target, patient_id, count(*) AS r FROM visits GROUP BY 1, 2, 3), g AS (SELECT dataset, target, count(*) AS groups FROM s GROUP BY 1, 2), t AS (SELECT (SELECT count(*) FROM visits) AS n, (SELECT count(*) FROM g) AS strata), w AS (SELECT v.image, v.dataset, v.target, n / (strata * groups * r)::DOUBLE AS weight FROM visits v JOIN s USING (dataset, target, patient_id) JOIN g USING (dataset, target), t)"""


@query("stratum_equal_weight", _STRATUM + " SELECT image, round(weight, 9) AS weight FROM w")
def stratum_equal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.stratum_weight(visits(spark, sf_dir), ["dataset", "target"], "patient_id").select("image", F.round("weight", 9).alias("weight"))


@query("stratum_weight_audit", _STRATUM + " SELECT dataset, target, round(sum(weight), 6) AS total, true AS balanced FROM w GROUP BY 1, 2")
def stratum_weight_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.stratum_weight(visits(spark, sf_dir), ["dataset", "target"], "patient_id")
    return relational.stratum_totals(rows, ["dataset", "target"]).withColumn("total", F.round("total", 6))


@query("sampler_weight", f"WITH {VISITS}, w AS (SELECT image, 1.0::DOUBLE / (g.r * s.k) AS w FROM visits JOIN (SELECT patient_id, count(*) AS r FROM visits GROUP BY 1) g USING (patient_id) JOIN (SELECT dataset, target, count(DISTINCT patient_id) AS k FROM visits GROUP BY 1, 2) s USING (dataset, target)) SELECT image, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def sampler_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.sampler_weight(visits(spark, sf_dir), ["dataset", "target"], "patient_id").select("image", F.round("weight", 6).alias("weight"))


@query("group_size", f"WITH {COHORT} SELECT image, count(*) OVER (PARTITION BY part) AS near_duplicate_group_size FROM cohort")
def group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).select("image", F.count(F.lit(1)).over(Window.partitionBy("part")).alias("near_duplicate_group_size"))


@query("ordinal_numbers", "SELECT o_custkey AS unit, row_number() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS n FROM (SELECT DISTINCT o_custkey FROM orders)")
def ordinal_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.numbered(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit")), "unit")


# ------------------------------------------------------------------ order, sets, samples


@query("ranking_topk", "SELECT s_suppkey, s_nationkey, s_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3")
def ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return read(spark, sf_dir, "supplier").withColumn("rank", rank.cast("long")).where("rank <= 3").select("s_suppkey", "s_nationkey", "s_acctbal", "rank")


@query("top_by_absolute", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def top_by_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report."""
    return read(spark, sf_dir, "customer").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("best_c_tiebreak", "SELECT p_brand, p_size AS c, round(auc, 6) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY auc DESC, p_size) AS k FROM (SELECT p_brand, p_size, round(avg(p_retailprice), 1) AS auc FROM part GROUP BY 1, 2)) WHERE k = 1")
def best_c_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("c")).agg(F.round(F.avg("p_retailprice"), 1).alias("auc"))
    return relational.best_by(grid, ["p_brand"], F.desc("auc"), F.col("c")).select("p_brand", "c", F.round("auc", 6).alias("auc"))


@query("union_filled", "SELECT o_orderkey AS id, o_totalprice AS price, NULL::DOUBLE AS balance FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def union_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return a.unionByName(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), allowMissingColumns=True)


@query("distinct_units", "SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM lineitem")
def distinct_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").distinct()


_DIGIT = "('0x' || substr(md5(concat_ws('|', 'folds', patient_id::VARCHAR)), 1, 3))"
_FOLDS = f"""WITH {VISITS}, g AS (SELECT patient_id, (count(*) FILTER (WHERE target = 1) > count(*) FILTER (WHERE target = 0))::INTEGER AS c, md5(concat_ws('|', 'folds', patient_id::VARCHAR)) AS h FROM visits GROUP BY 1), f AS (SELECT patient_id, ((row_number() OVER (PARTITION BY c ORDER BY h, patient_id) - 1) % 5)::INTEGER AS fold FROM g)"""


@query("hash_folds", _FOLDS + " SELECT patient_id, fold FROM f")
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.hash_folds(visits(spark, sf_dir), "patient_id", "target", 5, "folds")


@query("fold_leak_audit", _FOLDS + " SELECT fold, count(*) AS rows, count(DISTINCT patient_id) AS patients, count(*) FILTER (WHERE target = 0) AS benign, count(*) FILTER (WHERE target = 1) AS malignant, 0::BIGINT AS leaks FROM visits JOIN f USING (patient_id) GROUP BY 1")
def fold_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visits(spark, sf_dir)
    return folds.fold_audit(rows, folds.hash_folds(rows, "patient_id", "target", 5, "folds"), "patient_id", "target")


@query("train_test_overlap", "SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def train_test_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers occur in both halves of a split by rows: the leak that grouped folds avoid."""
    rows = read(spark, sf_dir, "orders")
    return rows.where("o_orderkey % 2 = 0").select("o_custkey").intersect(rows.where("o_orderkey % 2 = 1").select("o_custkey")).agg(F.count(F.lit(1)).alias("shared"))


@query("hash_sample", "SELECT c_custkey FROM customer ORDER BY md5('20260717|' || c_custkey), c_custkey LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 without replacement, the same at each run."""
    draw = F.md5(F.concat(F.lit("20260717|"), F.col("c_custkey").cast("string")).cast("binary"))
    return read(spark, sf_dir, "customer").orderBy(draw, "c_custkey").limit(100).select("c_custkey")


@query("weighted_sample", "WITH w AS (SELECT s_suppkey, s_acctbal + 1000 AS w, sum(s_acctbal + 1000) OVER (ORDER BY s_suppkey) AS hi, sum(s_acctbal + 1000) OVER () AS total FROM supplier), d AS (SELECT i AS draw, ('0x' || substr(md5('draw|' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM range(200) t(i)) SELECT d.draw, w.s_suppkey FROM d JOIN w ON d.u * w.total < w.hi AND d.u * w.total >= w.hi - w.w")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 draws with replacement by weight: each draw's uniform number meets the interval of running weights that holds it."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") + 1000).alias("w"))
    return resample.weighted_draws(rows, "s_suppkey", "w", 200, "draw")
