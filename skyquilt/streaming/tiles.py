"""Tiles as they arrive: running voxel counts and class counts of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyquilt.operators.points import KEY, with_voxel


def stream_points(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def voxel_counts(points: DataFrame, size: float) -> DataFrame:
    """Points and mean height of each voxel so far; works on streams in update or complete mode."""
    return with_voxel(points, size).groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("z").alias("z"))


def class_totals(points: DataFrame) -> DataFrame:
    return points.groupBy("label").agg(F.count("*").alias("n"))
