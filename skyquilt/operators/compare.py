"""Comparing two surveys: common voxels, boxes of buildings, tiles, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.geometry import box_iou
from skyquilt.operators.points import KEY, with_voxel
from skyquilt.storage import Scratch


def common_voxels(before: DataFrame, after: DataFrame, size: float) -> DataFrame:
    """``kx, ky, kz, label, pred``: voxels of both clouds, with the first label of each."""
    one = lambda p, name: with_voxel(p, size).groupBy(*KEY).agg(F.min_by("label", "idx").alias(name))
    return one(before, "label").join(one(after, "pred"), KEY)


def agreement(common: DataFrame) -> DataFrame:
    return common.agg(F.count("*").alias("common"), F.count_if(F.col("label") == F.col("pred")).alias("agreeing"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("agreement"))


def matched_ratio(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """How many predicted points have a reference label, by ``idx``."""
    joined = predicted.select("idx").join(reference.select("idx", F.lit(True).alias("hit")).distinct(), "idx", "left")
    return joined.agg(F.count("*").alias("points"), F.count("hit").alias("matched"), (F.count("hit") / F.count("*")).alias("matched_ratio"))


def best_boxes(model: DataFrame, reference: DataFrame, cell: float) -> DataFrame:
    """For every model box the reference box of largest overlap ratio, and how far their areas differ.

    Boxes have ``id, xmin, ymin, xmax, ymax``.  Equal boxes meet as one, of the
    reference the smallest id of them, so copies cost a row and not their square.
    Both sides are listed in the grid cells they touch and meet there, so only
    boxes that are close are compared; a model box that meets none has null
    partners.  Ties: the smallest id.
    """
    scratch, places = Scratch(model.sparkSession), ["xmin", "ymin", "xmax", "ymax"]
    # a row without a place has no box to share; + 0.0 makes one zero of two
    placed = lambda boxes: boxes.select("id", *[(F.col(c) + 0.0).alias(c) for c in places])
    models = scratch.save(placed(model).select(*places).distinct().withColumn("id", F.monotonically_increasing_id()))
    references = scratch.save(placed(reference).groupBy(*places).agg(F.min("id").alias("id")))

    def listed(boxes: DataFrame, p: str) -> DataFrame:
        spans = [F.sequence(F.floor(F.col(f"{a}min") / cell), F.floor(F.col(f"{a}max") / cell)) for a in "xy"]
        named = boxes.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", *places)], F.explode(spans[0]).alias("gx"), spans[1].alias("ys"))
        return named.withColumn("gy", F.explode("ys")).drop("ys")

    met = listed(models, "m_").join(listed(references, "r_"), ["gx", "gy"]).withColumn("iou", box_iou("m_", "r_"))
    area = lambda p: (F.col(f"{p}xmax") - F.col(f"{p}xmin")) * (F.col(f"{p}ymax") - F.col(f"{p}ymin"))
    best = met.where("iou > 0").groupBy(F.col("m_id").alias("id")).agg(F.max_by(F.struct(F.col("r_id"), area("r_").alias("area")), F.struct("iou", (-F.col("r_id")).alias("n"))).alias("r"), F.max("iou").alias("iou"))
    best = scratch.save(models.join(best, "id").select(*places, "r", "iou"))
    sized = placed(model).withColumn("model_area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    joined = sized.join(best, places, "left")
    return joined.select("id", "model_area", F.col("r.r_id").alias("ref_id"), F.col("r.area").alias("ref_area"), "iou", F.when(F.col("r.area") > 0, (F.col("model_area") - F.col("r.area")) / F.col("r.area") * 100).alias("deviation_pct"))


def tiles_in_box(tiles: DataFrame, points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Of every tile whose header box meets ``box``: its points, and how many lie inside.  The other tiles' points take no part; ``read_las`` with a box does not read them either."""
    x0, y0, x1, y1 = box
    touching = tiles.where((F.col("maxx") >= x0) & (F.col("minx") <= x1) & (F.col("maxy") >= y0) & (F.col("miny") <= y1))
    inside = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).groupBy("tile").agg(F.count("*").alias("points_in_box"))
    return touching.join(inside, "tile", "left").select("tile", F.col("points").alias("points_total"), F.coalesce("points_in_box", F.lit(0)).alias("points_in_box"))


def tile_headers(points: DataFrame) -> DataFrame:
    return points.groupBy("tile").agg(F.count("*").alias("points"), *[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def tile_totals(tiles: DataFrame, sizes: tuple[str, ...] = ("points", "bytes")) -> DataFrame:
    """One row: the number of tiles and, of each of ``sizes``, the total and the mean over tiles."""
    return tiles.agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in sizes], *[F.avg(c).alias(f"mean_{c}") for c in sizes])


def tile_averages(tiles: DataFrame, averaged: tuple[str, ...], summed: tuple[str, ...]) -> DataFrame:
    """One row: the plain mean over tiles of each score, and the total of each count."""
    return tiles.agg(*[F.avg(c).alias(c) for c in averaged], *[F.sum(c).alias(c) for c in summed])


def target_counts(targets: DataFrame, *areas: float) -> DataFrame:
    return targets.agg(F.count("*").alias("targets"), *[F.count_if(F.col("area") >= a).alias(f"targets_{a:g}") for a in areas], F.sum("area").alias("total_area"))


def before_after(before: DataFrame, after: DataFrame, *areas: float) -> DataFrame:
    """``target_counts`` of the buildings of two surveys side by side, and the change of each, in one row."""
    sides = [target_counts(t, *areas) for t in (before, after)]
    columns = sides[0].columns
    named = [t.select(*[F.col(c).alias(f"{side}_{c}") for c in columns]) for side, t in zip(("before", "after"), sides, strict=True)]
    return named[0].crossJoin(F.broadcast(named[1])).withColumns({f"change_{c}": F.col(f"after_{c}") - F.col(f"before_{c}") for c in columns})


def nearest_yaws(images: DataFrame, wanted=(0.0, 90.0, 180.0, 270.0), pitch: float = -60.0) -> DataFrame:
    """For each heading the image of the given pitch nearest to it, around the circle; ties by ``idx``."""
    turned = images.where(F.col("pitch") == pitch).withColumn("heading", F.explode(F.array(*map(F.lit, wanted))))
    off = F.abs(F.pmod(F.col("yaw") - F.col("heading") + 180.0, F.lit(360.0)) - 180.0)
    return turned.groupBy("heading").agg(F.min(F.struct(off.alias("off"), "idx", "yaw")).alias("m")).select("heading", "m.idx", "m.yaw", "m.off")


def production_rates(jobs: DataFrame) -> DataFrame:
    """Minutes and megabytes a second of jobs with ``start, end, gigabytes``."""
    minutes = (F.unix_timestamp("end") - F.unix_timestamp("start")) / 60.0
    return jobs.withColumn("minutes", minutes).withColumn("mb_per_s", F.when(minutes > 0, F.col("gigabytes") * 1024 / (minutes * 60)))


def ratio_to_first(rows: DataFrame, value: str, order: str) -> DataFrame:
    return rows.withColumn("ratio", F.col(value) / F.first(value).over(Window.orderBy(order)))
