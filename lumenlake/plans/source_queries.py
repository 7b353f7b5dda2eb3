"""Queries of sources, sinks and column groups: tables go out by a sink and come back by a source.

What they write lies in new folders below ``spark.checkpoint.dir``, like checkpoints, since a result is read after the query returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import registry
from lumenlake.operators import relational
from lumenlake.plans.registry import query, read
from lumenlake.session import shared_dir
from lumenlake.sources import files, sinks


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ tables


@query("csv_round_trip", "SELECT * FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = read(spark, sf_dir, "customer"), _folder(spark)
    sinks.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("semicolon_round_trip", "SELECT s_suppkey, s_name || ';' || s_nationkey AS quoted, s_acctbal FROM supplier")
def semicolon_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separator occurs inside a field as well."""
    rows, path = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(";", "s_name", F.col("s_nationkey").cast("string")).alias("quoted"), "s_acctbal"), _folder(spark)
    sinks.write_csv(rows, path, separator=";")
    return files.read_csv(spark, path, rows.schema, ";")


@query("part_files", "SELECT p_partkey, p_size, p_partkey // 500 * 500 AS part_start, count(*) OVER (PARTITION BY p_partkey // 500) AS part_rows FROM part")
def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of 500 keys each, told by the names they are stored under."""
    rows, path = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr("p_partkey div 500 * 500").alias("start")), _folder(spark)
    sizes = rows.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    named = rows.join(sizes, "start").select("p_partkey", "p_size", F.format_string("features_part_%05d_n%d", "start", "n").alias("part"))
    named.write.partitionBy("part").option("header", True).csv(path)
    return files.read_parts(spark, f"{path}/part=*", named.drop("part").schema)


@query("part_file_gaps", "SELECT 1000::BIGINT AS part_start, count(*) + 1 AS part_rows, count(*) AS rows, 500::BIGINT AS expected_start FROM part WHERE p_partkey BETWEEN 1000 AND 1499 HAVING count(*) > 0 AND max(p_partkey) >= 1000")
def part_file_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parts 0 to 499 and 1000 to 1499 the second begins too late and lacks a row of those its name says."""
    parts = read(spark, sf_dir, "part").where("p_partkey BETWEEN 0 AND 499 OR p_partkey BETWEEN 1000 AND 1499").select(F.expr("p_partkey div 500 * 500").alias("part_start"))
    sizes = parts.groupBy("part_start").agg(F.count(F.lit(1)).alias("n"))
    named = sizes.select("part_start", F.when(F.col("part_start") == 1000, F.col("n") + 1).otherwise(F.col("n")).alias("part_rows"))
    return files.part_gaps(parts.join(named, "part_start"))


@query("row_range", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey >= 40 AND p_partkey < 140")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.row_range(read(spark, sf_dir, "part"), "p_partkey", 40, 100).select("p_partkey", "p_name", "p_retailprice")


@query("tuned_parameters", "SELECT o_orderpriority AS direction, o_orderstatus AS feature_group, max(o_totalprice) AS c FROM orders GROUP BY ALL")
def tuned_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of directions and groups as one JSON document, and the parameters read from it."""
    path = _folder(spark)
    cells = read(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.struct(F.max("o_totalprice").alias("c")).alias("g"))
    groups = cells.groupBy("o_orderpriority").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "g"))).alias("groups")).alias("d"))
    sinks.write_summary(groups.agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "d"))).alias("directions")), path)
    return files.tuned_parameters(files.read_json(spark, path, "directions map<string, struct<groups: map<string, struct<c: double>>>>"))


@query("vector_round_trip", "SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last FROM embeddings")
def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    v = F.col("embedding")
    rows = files.read_embeddings(spark, path, "vec_id", "embedding", 64)
    return rows.select("vec_id", F.size(v).alias("n"), F.get(v, 0).cast("double").alias("first"), F.element_at(v, -1).cast("double").alias("last"))


@query("file_listing", "SELECT r_regionkey, (length(r_name) + 1)::BIGINT AS length, sha256(r_name || chr(10)) AS sha256, md5(r_name || chr(10)) AS md5 FROM region")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one line each with their digests."""
    path = _folder(spark)
    read(spark, sf_dir, "region").repartition("r_regionkey").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(path)
    rows = files.listing(spark, path, "*.txt", recursive=True)
    return rows.select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("int").alias("r_regionkey"), "length", "sha256", "md5")


# ------------------------------------------------------------------ results


@query("run_ledger", "SELECT o_orderpriority AS run, o_orderstatus, CASE WHEN o_orderpriority LIKE '1%' THEN -count(*) ELSE count(*) END AS n FROM orders GROUP BY o_orderpriority, o_orderstatus")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs are written, then one of them again; it is replaced alone."""
    path = _folder(spark)
    runs = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    sinks.append_run(runs, path, ["run"])
    sinks.append_run(runs.where(F.col("run").startswith("1")).withColumn("n", -F.col("n")), path, ["run"])
    return spark.read.schema(runs.schema).parquet(path).select("run", "o_orderstatus", "n")


@query("failure_log", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'missing_mask' ELSE 'empty_mask' END AS failure FROM lineitem WHERE l_discount = 0 OR l_quantity < 3")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_tax").alias("pixels"), F.when(F.col("l_discount") == 0, "missing_mask").when(F.col("l_quantity") < 3, "empty_mask").alias("failure"))
    sinks.write_failures(rows, path)
    return files.read_csv(spark, path, rows.drop("pixels").schema)


@query("exit_codes", "SELECT CASE WHEN bool_and(coalesce(c_acctbal >= -1000, false)) THEN 0 ELSE 2 END AS above, CASE WHEN bool_and(coalesce(c_acctbal > 0, false)) THEN 0 ELSE 1 END AS positive FROM customer")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select((F.col("c_acctbal") >= -1000).alias("above"), (F.col("c_acctbal") > 0).alias("positive"))
    return spark.createDataFrame([(sinks.exit_code(rows, "above"), sinks.exit_code(rows, "positive", 1))], "above int, positive int")


@query("matrix_round_trip", "SELECT o_orderstatus AS source, " + ", ".join(f"max(o_totalprice) FILTER (WHERE month(o_orderdate) = {m}) AS m{m}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, names = _folder(spark), [f"m{m}" for m in range(1, 13)]
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("source"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("target")).agg(F.max("o_totalprice").alias("auc"))
    sinks.write_matrix(rows, path, "source", "target", "auc", names)
    return files.read_csv(spark, path, ", ".join(["source string", *(f"{n} double" for n in names)]))


# ------------------------------------------------------------------ columns

_ZONES = "(VALUES ('lesion'), ('inner'), ('outer')) z(zone)"
_GROUPS_SQL = f"""WITH mf AS (SELECT 'advanced_mf_' || zone || '_' || signal || '_' || n AS name, zone FROM {_ZONES}, (VALUES ('intensity'), ('gradient')) s(signal), (VALUES ('d0'), ('d1'), ('d2'), ('spread'), ('r2_mean')) t(n)),
wavelet AS (SELECT 'advanced_wavelet_' || zone || '_l' || level || '_' || n AS name, zone FROM {_ZONES}, range(1, 4) s(level), (VALUES ('energy'), ('entropy'), ('hv_logratio'), ('diagonal_fraction')) t(n)),
tree AS (SELECT 'ct_' || zone || '_a' || area || '_' || side || '_' || n AS name FROM {_ZONES}, (VALUES (16), (64), (256)) s(area), (VALUES ('bright'), ('dark')) b(side), (VALUES ('mean'), ('q95'), ('fraction')) t(n)),
margin AS (SELECT 'zone_' || zone || '_' || n AS name FROM {_ZONES}, (
    SELECT 's' || scale || '_' || m AS n FROM (VALUES (0), (1), (2), (4)) s(scale), (VALUES ('max_density'), ('min_density'), ('balance'), ('intensity_gap')) t(m)
    UNION ALL SELECT unnest(['s1_max_boxdim', 's1_min_boxdim', 'scale_count_slope', 'scale_count_r2', 'density_auc'])) t WHERE zone <> 'lesion')
SELECT 'multifractal30' AS feature_group, name AS feature FROM mf UNION ALL SELECT 'wavelet36', name FROM wavelet
UNION ALL SELECT 'gfw66', name FROM mf UNION ALL SELECT 'gfw66', name FROM wavelet
UNION ALL SELECT zone || '22', name FROM mf UNION ALL SELECT zone || '22', name FROM wavelet
UNION ALL SELECT 'component_tree', name FROM tree UNION ALL SELECT '^ct_', name FROM tree UNION ALL SELECT 'margin', name FROM margin"""


@query("feature_groups", _GROUPS_SQL)
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that named groups, a pattern and two prefixes choose from the wide table."""
    wide = spark.createDataFrame([], ", ".join(f"{c} double" for c in registry.ALL))
    chosen = {g: registry.group_columns(wide.columns, g) for g in ("multifractal30", "wavelet36", "gfw66", "lesion22", "inner22", "outer22", "component_tree")}
    chosen["^ct_"] = wide.select(wide.colRegex("`^ct_.*`")).columns
    chosen["margin"] = [c for c in wide.columns if c.startswith(("zone_inner_", "zone_outer_"))]
    return spark.createDataFrame([(g, c) for g, names in chosen.items() for c in names], "feature_group string, feature string")


@query("missing_columns", "SELECT unnest(['l_tax', 'l_orderkey', 'p_base', 'o_custkey']) AS name EXCEPT SELECT column_name FROM (DESCRIBE lineitem)")
def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = ["l_tax", "l_orderkey", "p_base", "o_custkey"]
    return spark.createDataFrame([(c,) for c in relational.missing_columns(read(spark, sf_dir, "lineitem"), needed)], "name string")


@query("same_columns", "SELECT 'l_partkey' AS other, (SELECT list(column_name) FROM (DESCRIBE lineitem)) = (SELECT list(column_name) FROM (DESCRIBE lineitem)) AS same, (SELECT list(column_name) FROM (DESCRIBE lineitem)) = (SELECT list(column_name) FROM (DESCRIBE lineitem) WHERE column_name <> 'l_partkey') AS same_without")
def same_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of equal feature columns, held by a table with itself and broken without one column."""
    rows = read(spark, sf_dir, "lineitem")

    def holds(other: DataFrame) -> bool:
        try:
            registry.require_same(rows.columns, other.columns)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([("l_partkey", holds(rows), holds(rows.drop("l_partkey")))], "other string, same boolean, same_without boolean")


_BYTE = "floor(abs(embedding[{}]::DOUBLE) * 1000)::BIGINT % 256"


@query("mask_colours", f"""WITH px AS (SELECT vec_id, {_BYTE.format("3 * i + 1")} AS r, {_BYTE.format("3 * i + 2")} AS g, {_BYTE.format("3 * i + 3")} AS b FROM embeddings, range(21) t(i))
SELECT vec_id AS name, count(*) FILTER (WHERE r > 200 AND g < 50 AND b < 50) AS red_pixels, count(*) FILTER (WHERE g > 200 AND r < 50 AND b < 50) AS green_pixels, count(*) FILTER (WHERE r > 0 OR g > 0 OR b > 0) AS foreground_pixels FROM px GROUP BY 1""")
def mask_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as colour masks of 21 pixels."""
    plane = F.transform(F.slice("embedding", 1, 63), lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256)
    return files.mask_colours(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), plane.alias("pixels")))
