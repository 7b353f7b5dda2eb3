"""Cohorts that the queries run on, as Spark frames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.plans.registry import read

#: lineitem as predictions: an image is a line, a patient an order.
COHORT = """cohort AS (
  SELECT l_orderkey * 10 + l_linenumber AS image, l_orderkey AS patient_id, l_linestatus AS dataset,
    CASE WHEN l_returnflag = 'R' THEN 'malignant' ELSE 'benign' END AS label, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target,
    l_discount * 10 AS p_base, l_tax * 12.5 AS p_alt, l_quantity / 50 AS p_fine, l_partkey AS part, l_extendedprice AS price
  FROM lineitem)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    malignant = F.col("l_returnflag") == "R"
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image"),
        F.col("l_orderkey").alias("patient_id"),
        F.col("l_linestatus").alias("dataset"),
        F.when(malignant, "malignant").otherwise("benign").alias("label"),
        F.when(malignant, 1).otherwise(0).alias("target"),
        (F.col("l_discount") * 10).alias("p_base"),
        (F.col("l_tax") * 12.5).alias("p_alt"),
        (F.col("l_quantity") / 50).alias("p_fine"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("price"),
    )


#: orders as predictions: a patient is a customer, a few images each.
VISITS = """visits AS (
  SELECT o_orderkey AS image, o_custkey AS patient_id, o_orderpriority AS dataset, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
    (o_orderkey % 97) / 96.0::DOUBLE AS p_a, (o_custkey % 89) / 88.0::DOUBLE AS p_b FROM orders)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image"),
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"),
        ((F.col("o_orderkey") % 97) / F.lit(96.0)).alias("p_a"),
        ((F.col("o_custkey") % 89) / F.lit(88.0)).alias("p_b"),
    )


#: embeddings as 8 x 8 pictures, one row a pixel.
PIXELS = """pixels AS (
  SELECT vec_id AS image, i // 8 AS r, i % 8 AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "x"))
    return rows.select("image", F.expr("i div 8").alias("r"), (F.col("i") % 8).cast("long").alias("c"), F.col("x").cast("double").alias("v"))


def pictures(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """embeddings as gray pictures of 0..255 (each stretched to its own range) with a disk as mask: image, height, width, pixels, mask."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    low, high = F.array_min("x"), F.array_max("x")
    gray = F.transform("x", lambda v: F.floor(F.lit(255.0) * (v - low) / F.greatest(high - low, F.lit(1e-12))))
    mask = [1 if (r - 3.5) ** 2 + (c - 3.5) ** 2 <= 7 else 0 for r in range(side) for c in range(side)]
    return rows.select("image", F.lit(side).alias("height"), F.lit(side).alias("width"), gray.cast("array<double>").alias("pixels"), F.array(*map(F.lit, mask)).alias("mask"))
