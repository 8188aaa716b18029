"""A made scene of five kinds of ground cover, for runs without a survey."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The side of the scene, and the shares of its points by kind.
SIDE = 120.0
SHARES = {"bare": 0.22, "road": 0.10, "building": 0.12, "tree": 0.025, "pole": 0.006}
# Ranges of red, green and blue (0 to 255) by kind.
COLOURS = {"bare": ((120, 160), (110, 150), (90, 130)), "road": ((90, 120), (90, 120), (95, 125)), "roof": ((130, 170), (130, 170), (140, 180)), "tree": ((30, 80), (90, 170), (40, 90)), "pole": ((200, 240), (190, 225), (160, 200))}
LABELS = {"building": 1, "road": 2, "tree": 3, "bare": 4, "pole": 5}


def demo_scene(spark: SparkSession, points: int = 6000, seed: int = 2026) -> DataFrame:
    """``idx, x, y, z, r, g, b, label`` of ground, two roads, 2 to 4 buildings, 4 to 7 trees and 5 poles.

    Every number is drawn by a hash of the seed, the kind, the object and the
    point, so the scene is the same however it is partitioned.  The centroid is
    at the origin.
    """
    salt = iter(range(1_000_000))

    def unit(*what: Column) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(next(salt)), *what) / F.lit(2.0**64) + 0.5

    def between(low: Column | float, high: float, *what: Column) -> Column:
        return low + (high - low) * unit(*what)

    def normal(mean: Column | float, deviation: Column | float, *what: Column) -> Column:
        size = F.sqrt(-2 * F.log(F.greatest(unit(*what), F.lit(1e-12))))
        return mean + deviation * size * F.cos(2 * pi * unit(*what))

    def whole(low: int, high: int) -> Column:
        return F.floor(between(low, high)).cast("int")

    def objects(number: Column | int, each: int) -> DataFrame:
        """A row for each point of each object: ``o`` and ``i``."""
        made = spark.range(1).select(F.explode(F.sequence(F.lit(0), (number if isinstance(number, Column) else F.lit(number)) - 1)).alias("o"))
        return made.crossJoin(spark.range(each).withColumnRenamed("id", "i"))

    o, i = F.col("o"), F.col("i")
    shade = lambda kind: {c: between(*COLOURS[kind][k], o, i) for k, c in enumerate("rgb")}
    counts = {k: int(points * s) for k, s in SHARES.items()}
    bare = objects(1, counts["bare"]).withColumns({"x": between(0, SIDE, i), "y": between(0, SIDE, i), "z": normal(0.0, 0.12, i), **shade("bare")})
    road = objects(2, counts["road"]).withColumns({"x": between(0, SIDE, o, i), "y": F.when(o == 0, 25.0).otherwise(80.0) + between(0, 5, o, i), "z": normal(0.01, 0.02, o, i), **shade("road")})

    house = objects(whole(2, 5), counts["building"])
    house = house.withColumns({"cx": between(15, 105, o), "cy": between(38, 72, o), "sx": between(8, 18, o), "sy": between(8, 18, o), "h": between(8, 20, o), "part": F.floor(unit(o, i) * 100)})
    side = F.floor(F.col("part") / 14)  # 14 in a hundred on each wall, the rest on the roof
    across, along = between(-0.5, 0.5, o, i), between(-0.5, 0.5, o, i)
    wall, ends = side < 4, side >= 2
    sign = F.when(side % 2 == 0, -0.5).otherwise(0.5)
    jitter = normal(0.0, 0.02, o, i)
    base = between(F.when(ends, 170.0).otherwise(160.0), 220, o, i) * F.when(side == 0, 1.0).when(side == 1, 0.85).when(side == 2, 0.8).otherwise(0.95)
    roof = shade("roof")
    house = house.withColumns({
        "x": F.col("cx") + F.col("sx") * F.when(wall & ends, sign).otherwise(across) + F.when(wall & ends, jitter).otherwise(0.0),
        "y": F.col("cy") + F.col("sy") * F.when(wall & ~ends, sign).otherwise(along) + F.when(wall & ~ends, jitter).otherwise(0.0),
        "z": F.when(wall, 0.2 + (F.col("h") - 0.2) * unit(o, i)).otherwise(normal(F.col("h"), 0.03, o, i)),
        **{c: F.when(wall, base * k).otherwise(roof[c]) for c, k in zip("rgb", (1.0, 0.92, 0.82), strict=True)},
    })

    tree = objects(whole(4, 8), counts["tree"])
    turn, up, reach = between(0, 2 * pi, o, i), between(-1, 1, o, i), unit(o, i) ** (1.0 / 3.0)
    flat = F.sqrt(F.greatest(1 - up * up, F.lit(0.0))) * reach
    tree = tree.withColumns({
        "x": between(5, 115, o) + between(2, 4, o) * flat * F.cos(turn), "y": between(5, 115, o) + between(2, 4, o) * flat * F.sin(turn),
        "z": F.greatest(F.abs(up * reach) * between(1.5, 3.5, o), F.lit(0.05)), **shade("tree"),
    })
    pole = objects(5, max(counts["pole"], 30)).withColumns({"x": normal(between(3, 117, o), 0.04, o, i), "y": normal(between(3, 117, o), 0.04, o, i), "z": 0.1 + (between(4, 7, o) - 0.1) * unit(o, i), **shade("pole")})

    kinds = {"bare": bare, "road": road, "building": house, "tree": tree, "pole": pole}
    parts = [d.select(F.xxhash64(F.lit(seed), F.lit(k), o, i).alias("idx"), "x", "y", "z", "r", "g", "b", F.lit(LABELS[k]).alias("label")) for k, d in kinds.items()]
    scene = reduce(DataFrame.union, parts)
    centre = scene.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    return scene.crossJoin(F.broadcast(centre)).withColumns({a: F.col(a) - F.col(f"m{a}") for a in "xyz"}).drop("mx", "my", "mz")
