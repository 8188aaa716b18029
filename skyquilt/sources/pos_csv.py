"""Camera pose tables, and the lists and reports that screening writes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The header names by which a field is known.
ALIASES = {
    "name": ["name", "file", "image", "filename", "影像名", "文件名", "影像"],
    "lon": ["lon", "longitude", "经度", "x_lon"],
    "lat": ["lat", "latitude", "纬度", "y_lat"],
    "alt": ["alt", "altitude", "height", "z", "高程", "飞行高度"],
    "x": ["x", "east", "easting", "东坐标", "x_local"],
    "y": ["y", "north", "northing", "北坐标", "y_local"],
    "omega": ["omega", "roll", "横滚角", "侧滚角"],
    "phi": ["phi", "pitch", "俯仰角"],
    "kappa": ["kappa", "yaw", "heading", "航向角", "偏航角"],
}
_FIELD = {alias: field for field, aliases in reversed(ALIASES.items()) for alias in reversed(aliases)}
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".dng")


def field_of(header: str) -> str | None:
    """The field a header names: blanks, brackets and a byte order mark do not count, nor does case."""
    return _FIELD.get(re.sub(r"[\s()\ufeff]+", "", header).casefold())


def read_pos(spark: SparkSession, path: str) -> DataFrame:
    """Records in file order: ``idx`` (from 0), ``name``, lon, lat, alt, x, y and the three angles.

    Columns are known by name, in any order; unknown ones are left out.  Blank
    rows are skipped, empty cells are null, other text in a number is an error.
    Missing names are counted, missing angles and heights are 0.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    fields: dict[str, str] = {}
    for column in raw.columns:
        field = field_of(column)
        if field and field not in fields:
            fields[field] = column
    if not fields:
        raise ValueError(f"no known column in {path}: {raw.columns}")
    cell = lambda f: F.nullif(F.trim(F.col(f"`{fields[f]}`")), F.lit("")) if f in fields else F.lit(None).cast("string")
    filled = reduce(lambda a, b: a | b, [cell(f).isNotNull() for f in fields])
    # file order: files by path, rows as read; pose tables have a row an image
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")).where(filled)
    rows = rows.withColumn("idx", F.row_number().over(Window.orderBy("_file", "_row")) - 1)
    number = lambda f: cell(f).cast("double")
    zero = lambda f: F.coalesce(number(f), F.lit(0.0))
    return rows.select(
        F.col("idx").cast("long").alias("idx"), F.coalesce(cell("name"), F.format_string("image_%06d", F.col("idx") + 1)).alias("name"),
        number("lon").alias("lon"), number("lat").alias("lat"), zero("alt").alias("z"), number("x").alias("x"), number("y").alias("y"), *[zero(f).alias(f) for f in ("omega", "phi", "kappa")],
    )


def list_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path`` of the image files of a folder, hidden ones left out, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    base = F.element_at(F.split("path", "/"), -1)
    known = reduce(lambda a, b: a | b, [F.lower("path").endswith(s) for s in IMAGE_SUFFIXES])
    return files.where(known & ~base.startswith(".")).orderBy("path")


def report_text(scores: DataFrame, cells: int) -> DataFrame:
    """The coverage report as text columns: six decimals, yes or no."""
    six: list[Column] = [F.format_string("%.6f", F.col(c)).alias(c) for c in ("base_ratio", "new_ratio", "score")]
    return scores.select("idx", F.col("covered").alias("covered_grids"), F.lit(cells).alias("total_grids"), *six, F.when(F.col("keep"), "yes").otherwise("no").alias("keep"))


def write_report(scores: DataFrame, cells: int, path: str) -> None:
    """The coverage report as CSV, in order of ``idx``."""
    report_text(scores, cells).orderBy("idx").write.mode("overwrite").option("header", True).csv(path)


def target_text(targets: DataFrame) -> DataFrame:
    """The building table as text columns in order of ``xmin``: metres with three decimals, areas with two."""
    metres = [F.format_string("%.3f", F.col(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax", "height", "zmin", "zmax")]
    return targets.orderBy("xmin", "cluster_id").select("cluster_id", "points", *metres, F.format_string("%.2f", F.col("area")).alias("area"))


def write_targets(targets: DataFrame, path: str) -> None:
    target_text(targets).write.mode("overwrite").option("header", True).csv(path)


def write_lists(kept: DataFrame, folder: str) -> None:
    """Paths of kept and of removed images, a text file set each."""
    for name, wanted in (("kept", F.col("keep")), ("removed", ~F.col("keep"))):
        kept.where(wanted).orderBy("idx").select("file").write.mode("overwrite").text(f"{folder}/{name}")


def demo_pos(spark: SparkSession) -> DataFrame:
    """A made survey (its numbers are fixed values): 7 lines of 16 stations, each with a nadir and an oblique image facing east, and 6 images far off; 230 records."""
    station = spark.range(7 * 16).select((F.col("id") / 16).cast("int").alias("line"), (F.col("id") % 16).alias("at"))
    views = station.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1))))
    number = (F.col("line") * 16 + F.col("at")) * 2 + F.col("view")
    x, y = F.col("at") * 60.0 - F.col("view") * 20.0, F.col("line") * 120.0 + F.when(F.col("line") % 2 == 1, 30.0).otherwise(-30.0)
    flown = views.select(number.alias("idx"), F.format_string("IMG_%05d", number + 1).alias("name"), x.alias("x"), y.alias("y"), (F.col("view") * 25.0).alias("phi"), (F.col("view") * 90.0).alias("kappa"))
    far = spark.range(6).select((F.col("id") + 224).alias("idx"), F.format_string("FAR_%02d", F.col("id")).alias("name"), (1200.0 + 80.0 * F.col("id")).alias("x"), (900.0 + 100.0 * F.col("id")).alias("y"), F.lit(0.0).alias("phi"), F.lit(0.0).alias("kappa"))
    lon, lat = F.lit(120.3) + F.col("x") / 111320.0, F.lit(31.2) + F.col("y") / 110540.0
    return flown.unionByName(far).select("idx", "name", lon.alias("lon"), lat.alias("lat"), F.lit(120.0).alias("z"), F.lit(0.0).alias("omega"), "phi", "kappa")
