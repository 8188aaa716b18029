"""The warehouse tables as survey inputs, so that every operator can be run and compared on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as images: 40 stations a line, some oblique, some that look past the horizon."""
    c = table(spark, sf_dir, "customer")
    phi = F.get(F.array(*map(F.lit, (0.0, 25.0, 25.0, 0.0, 75.0))), F.col("c_nationkey") % 5)
    return c.select(
        F.col("c_custkey").alias("idx"), ((F.col("c_custkey") % 40) * 60).cast("double").alias("x"), (F.floor(F.col("c_custkey") / 40) * 30).cast("double").alias("y"),
        F.lit(120.0).alias("z"), F.lit(0.0).alias("omega"), phi.alias("phi"), (F.col("c_nationkey") % 4 * 90.0).alias("kappa"),
    )


def embedded_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as points: place and colour from their first six numbers."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.col("vec_id").alias("idx"), *[(at(i) * 100).alias(a) for i, a in enumerate("xyz")], *[(at(i + 3) + 0.5).alias(c) for i, c in enumerate("rgb")], (F.col("label") % 6).cast("int").alias("label"))


def _line_points(items: DataFrame) -> DataFrame:
    """Order lines as points."""
    return items.select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 100).alias("z"), (F.col("l_linenumber") % 6).cast("int").alias("label"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def line_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as points.

    ``idx`` stands for the order of a file: one number of 38 digits made from the
    columns that tell lines apart, so no task needs to number all rows and
    minima of it are hash aggregates.
    """
    p = _line_points(table(spark, sf_dir, "lineitem"))
    digits = F.expr("cast(l_orderkey * 100 + l_linenumber as decimal(18, 0)) * cast('100000000000000000000' as decimal(21, 0)) + cast(l_partkey * 10000000000 + l_suppkey as decimal(20, 0))")
    return p.select(digits.cast("decimal(38,0)").alias("idx"), "x", "y", "z", "label", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


SQL = """
pos AS (
  SELECT c_custkey AS idx, CAST(c_custkey % 40 * 60 AS DOUBLE) AS x, CAST(c_custkey // 40 * 30 AS DOUBLE) AS y, CAST(120 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS omega,
         CAST([0, 25, 25, 0, 75][c_nationkey % 5 + 1] AS DOUBLE) AS phi, CAST(c_nationkey % 4 * 90 AS DOUBLE) AS kappa
  FROM customer),
cloud AS (
  SELECT vec_id AS idx, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z,
         embedding[4]::DOUBLE + 0.5::DOUBLE AS r, embedding[5]::DOUBLE + 0.5::DOUBLE AS g, embedding[6]::DOUBLE + 0.5::DOUBLE AS b, CAST(label % 6 AS INTEGER) AS label
  FROM embeddings),
lines AS (
  SELECT l_quantity AS x, l_extendedprice / 2000::DOUBLE AS y, l_discount * 100::DOUBLE AS z, CAST(l_linenumber % 6 AS INTEGER) AS label,
         struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice, f := l_shipdate) AS idx,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem)
"""
