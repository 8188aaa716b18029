"""Image screening: footprints, coverage of a grid, contribution scores, selection and repair of gaps."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce
from math import ceil, cos, radians

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.config import Camera, ScreeningConfig
from skyquilt.functions import geometry as G
from skyquilt.operators.numbering import numbered
from skyquilt.storage import Scratch


@dataclass(frozen=True)
class Grid:
    """Cell centres of a box: start, step and number on each axis."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int

    @property
    def cells(self) -> int:
        return self.nx * self.ny


def make_grid(xmin: float, ymin: float, xmax: float, ymax: float, step: float) -> Grid:
    """Centres from half a step inside the lower edge, short of the upper edge; an empty grid is an error."""
    if not (xmax > xmin and ymax > ymin and step > 0):
        raise ValueError("the study area is empty")
    x0, y0 = xmin + step / 2, ymin + step / 2
    nx, ny = max(0, ceil((xmax - x0) / step)), max(0, ceil((ymax - y0) / step))
    if not nx * ny:
        raise ValueError("no cell centre lies in the study area")
    return Grid(x0, y0, (x0 + step) - x0, (y0 + step) - y0, nx, ny)


def resolve_camera(pos: DataFrame, given: Camera | None) -> Camera:
    """The given camera, else that of the first record (by ``idx``) with focal length and image size, else the default."""
    wanted = {"focal_mm", "image_width_px", "image_height_px"}
    if given or not wanted <= set(pos.columns):
        return given or Camera()
    full = pos.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in wanted]))
    have = full.orderBy("idx").limit(1).collect()
    if not have:
        return Camera()
    row = have[0].asDict()
    return Camera(row["focal_mm"], row.get("sensor_width_mm") or 36.0, row.get("sensor_height_mm") or 24.0, row["image_width_px"], row["image_height_px"])


def is_plane(pos: DataFrame) -> bool:
    """Whether the first record (by ``idx``) has a place in metres."""
    if not {"x", "y"} <= set(pos.columns):
        return False
    first = pos.orderBy("idx").select("x", "y").first()
    return first is not None and first["x"] is not None and first["y"] is not None


def origin_of(pos: DataFrame, lon: float | None = None, lat: float | None = None) -> tuple[float | None, float | None]:
    """Degrees of the local origin: as given, else the mean of all records; one row to the driver."""
    if lon is None or lat is None:
        mean = pos.agg(F.avg("lon"), F.avg("lat")).first()
        lon, lat = mean[0] if lon is None else lon, mean[1] if lat is None else lat
    return lon, lat


def localise(pos: DataFrame, ref_lon: float | None = None, ref_lat: float | None = None) -> DataFrame:
    """x and y in metres from lon and lat; the origin is given or the mean of all records."""
    lon0, lat0 = (F.lit(v).cast("double") for v in origin_of(pos, ref_lon, ref_lat))
    x, y = G.local_xy(F.col("lon"), F.col("lat"), lon0, lat0)
    return pos.withColumns({"x": x, "y": y})


def footprints(pos: DataFrame, camera: Camera, z_ref: float = 0.0) -> DataFrame:
    """``idx, polygon, area, xmin .. ymax`` of the images all of whose corners see ground; the others have no row."""
    polygon = G.footprint(camera, *[F.col(c) for c in ("x", "y", "z", "omega", "phi", "kappa")], z_ref)
    shape = G.bound(polygon, lambda p: F.struct(p.alias("polygon"), G.polygon_area(p).alias("area"), *[c.alias(n) for n, c in G.bbox(p).items()]))
    return pos.select("idx", shape.alias("s")).where("s.area >= 1e-6").select("idx", "s.*")


def study_area(prints: DataFrame, config: ScreeningConfig, origin: tuple[float | None, float | None] = (None, None)) -> tuple[float, float, float, float]:
    """The given box (in degrees or metres), else the box of all footprints and a margin: one row to the driver."""
    if config.area_lonlat:
        if None in origin:
            raise ValueError("a study area in degrees needs an origin: records with lon and lat, or ref_lon and ref_lat")
        (lon0, lat0), (a, b, c, d) = origin, config.area_lonlat
        scale = G.METRES_PER_DEGREE_LON * cos(radians(lat0))
        xs, ys = sorted(((a - lon0) * scale, (c - lon0) * scale)), sorted(((b - lat0) * G.METRES_PER_DEGREE_LAT, (d - lat0) * G.METRES_PER_DEGREE_LAT))
        return xs[0], ys[0], xs[1], ys[1]
    if config.area:
        return config.area
    m = config.area_margin
    row = prints.agg(F.min("xmin") - m, F.min("ymin") - m, F.max("xmax") + m, F.max("ymax") + m).first()
    if row[0] is None:
        raise ValueError("no image sees ground")
    return tuple(row)


def coverage(prints: DataFrame, grid: Grid) -> DataFrame:
    """``idx, ix, iy`` of the cells whose centre lies in a footprint.

    Cells are numbered, so each image lists those of its own box and tests
    them: no join, and work in proportion to the area covered.  Images are dealt
    out first, as a pose table is small and its cells are many; corners stand in
    plain columns, so the test is compiled.
    """
    def span(lo: str, hi: str, start: float, step: float, n: int):
        first = F.greatest(F.ceil((F.col(lo) - start) / step) - 1, F.lit(0))
        last = F.least(F.floor((F.col(hi) - start) / step) + 1, F.lit(n - 1))
        return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))

    corners = [F.col("polygon")[k][axis].alias(f"{axis}{k}") for k in range(4) for axis in ("x", "y")]
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("idx", *corners, "xmin", "xmax", "ymin", "ymax").repartition(partitions, "idx")
    names = [c for k in range(4) for c in (f"x{k}", f"y{k}")]
    cells = dealt.select("idx", *names, span("ymin", "ymax", grid.y0, grid.dy, grid.ny).alias("ys"), F.explode(span("xmin", "xmax", grid.x0, grid.dx, grid.nx)).alias("ix"))
    cells = cells.select("idx", *names, "ix", F.explode("ys").alias("iy"))
    inside = G.in_corners(F.lit(grid.x0) + F.col("ix") * grid.dx, F.lit(grid.y0) + F.col("iy") * grid.dy, [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)])
    return cells.where(inside).select("idx", "ix", "iy")


def contribution(images: DataFrame, cover: DataFrame, cells: int, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """``idx, covered, base_ratio, new_ratio, score`` of every image.

    Taken in order of coverage (the smaller ``idx`` first on ties), an image adds
    the cells that none before it covers; the first image of that order to cover
    a cell owns it, so a cell's owner is one minimum and counting owned cells
    replaces the scan.
    """
    if min(alpha, beta) < 0:
        raise ValueError("weights must not be negative")
    counts = cover.groupBy("idx").agg(F.count("*").alias("covered"))
    first = F.max_by(F.col("idx"), F.struct("covered", -F.col("idx"))).alias("idx")
    owned = cover.join(counts, "idx").groupBy("ix", "iy").agg(first).groupBy("idx").agg(F.count("*").alias("owned"))
    base, new = F.col("covered") / cells, F.coalesce("owned", F.lit(0)) / cells
    counted = images.select("idx").join(counts, "idx", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return counted.join(owned, "idx", "left").select("idx", "covered", base.alias("base_ratio"), new.alias("new_ratio"), (alpha * base + beta * new).alias("score"))


def select_images(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumn("keep", F.col("score") >= threshold)


PAIRS_PER_BLOCK = 2_000_000  # (image, open cell) pairs that one task holds


def _taken(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of the images of a block those that the sequential choice certainly takes, whatever happens outside.

    ``idx, ix, iy`` and, where other blocks cover the cell too, ``rival``: the best
    of theirs, its gain and the negative of its number.  Images come off a heap in
    order of gain.  One has to wait if a rival of one of its open cells, or an
    image that waits already, comes before it; all others are taken and close
    their cells.  Gains of others only fall, so an image with an outdated gain
    goes back, and what came before it stays before it.
    """
    cells = pairs.groupby(["ix", "iy"], sort=False).ngroup().to_numpy()
    n = int(cells.max()) + 1
    rival_gain, rival_minus = np.full(n, -np.inf), np.zeros(n)
    known = pairs["rival_gain"].notna().to_numpy()
    rival_gain[cells[known]], rival_minus[cells[known]] = pairs["rival_gain"].to_numpy()[known], pairs["rival_minus"].to_numpy()[known]
    # an image's cells lie together: arrays, as a set for each image takes several times their memory
    idx = pairs["idx"].to_numpy()
    order = np.lexsort((cells, idx))
    idx, cells = idx[order], cells[order]
    once = np.append(True, (idx[1:] != idx[:-1]) | (cells[1:] != cells[:-1]))
    idx, cells = idx[once], cells[once]
    starts = np.flatnonzero(np.append(True, idx[1:] != idx[:-1]))
    ends = np.append(starts[1:], len(idx))
    heap = [(start - end, i, start, end) for i, start, end in zip(idx[starts].tolist(), starts.tolist(), ends.tolist(), strict=True)]
    heapq.heapify(heap)
    closed, waits = np.zeros(n, bool), np.zeros(n, bool)
    taken = []
    while heap:
        gain, i, start, end = heapq.heappop(heap)
        some = cells[start:end]
        some = some[~closed[some]]
        if not len(some):
            continue
        theirs = rival_gain[some]
        if len(some) < -gain:
            heapq.heappush(heap, (-len(some), i, start, end))
        elif (waits[some] | (theirs > -gain) | ((theirs == -gain) & (rival_minus[some] > -i))).any():
            waits[some] = True
        else:
            taken.append(i)
            closed[some] = True
    return pd.DataFrame({"idx": pd.Series(taken, dtype="int64")})


def repair_gaps(kept: DataFrame, cover: DataFrame) -> DataFrame:
    """Adds rejected images until every cell that some image covers is covered by a kept one.

    The image with the most uncovered cells comes first, the smaller ``idx`` on
    ties, one after the other.  Images are put in order by place and cut into
    blocks of about ``PAIRS_PER_BLOCK`` (image, uncovered cell) pairs.  A task runs
    the choice over a block and takes all images that come before every other
    block's images at their cells: these images' present gains bound what they
    can have later.  So a chain of images of which each decides about the next is
    followed within a task; only where it passes into the next block does it wait
    for the next round, whose blocks are cut half-way between.
    """
    scratch = Scratch(kept.sparkSession)
    rejected = kept.where("not keep").select("idx")
    covered = cover.join(kept.where("keep").select("idx"), "idx", "left_semi").select("ix", "iy").distinct()
    pairs, seen = scratch.save_counted(cover.join(rejected, "idx", "left_semi").join(covered, ["ix", "iy"], "left_anti").select("idx", "ix", "iy"), n=F.count("*"))
    if not seen["n"]:
        return kept.withColumn("added", F.lit(False))
    first = scratch.save(pairs.groupBy("idx").agg(F.min("ix").alias("fx"), F.min("iy").alias("fy")))
    placed, images = scratch.save_counted(numbered(scratch, first, ["fx", "fy", "idx"], "at").select("idx", "at"), n=F.count("*"))
    per_block = max(2, PAIRS_PER_BLOCK * images["n"] // seen["n"])
    added, turn, several = None, 0, images["n"] > per_block
    while seen["n"]:
        block = F.floor((F.col("at") + (per_block // 2 if turn % 2 else 0)) / per_block)
        dealt = pairs.join(placed, "idx").select("idx", "ix", "iy", block.alias("block"))
        none = F.lit(None).cast("double")
        if several:
            gain = pairs.groupBy("idx").agg(F.count("*").alias("gain"))
            best = F.max(F.struct("gain", (-F.col("idx")).alias("minus"))).alias("best")
            of_blocks = dealt.join(gain, "idx").groupBy("ix", "iy", "block").agg(best)
            place = Window.partitionBy("ix", "iy").orderBy(F.desc("best"))
            two = of_blocks.withColumn("place", F.row_number().over(place)).where("place <= 2")  # the best of another block is one of these
            rivals = two.groupBy("ix", "iy").agg(*[F.max(F.when(F.col("place") == k, F.struct("block", "best"))).alias(f"b{k}") for k in (1, 2)])
            other = F.when(F.col("b1.block") != F.col("block"), F.col("b1.best")).otherwise(F.col("b2.best"))
            dealt = dealt.join(rivals, ["ix", "iy"]).withColumn("other", other).select("idx", "ix", "iy", "block", F.col("other.gain").cast("double").alias("rival_gain"), F.col("other.minus").cast("double").alias("rival_minus"))
        else:
            dealt = dealt.withColumns({"rival_gain": none, "rival_minus": none})
        chosen = scratch.save(dealt.groupBy("block").applyInPandas(_taken, "idx long"))
        added = chosen if added is None else added.union(chosen)
        if not several:
            break
        done = pairs.join(chosen, "idx", "left_semi").select("ix", "iy").distinct()
        now, seen = scratch.save_counted(pairs.join(done, ["ix", "iy"], "left_anti"), n=F.count("*"))
        scratch.drop(pairs)
        pairs, turn = now, turn + 1
    scratch.drop(pairs, first, placed)
    return kept.join(added.withColumn("added", F.lit(True)), "idx", "left").withColumn("added", F.coalesce("added", F.lit(False))).withColumn("keep", F.col("keep") | F.col("added"))


def summary(kept: DataFrame) -> DataFrame:
    n, m = F.count("*"), F.count_if("keep")
    return kept.agg(n.alias("n_images"), m.alias("n_kept"), (n - m).alias("n_removed"), F.round(F.when(n > 0, (n - m) * 100.0 / n), 6).alias("removed_pct"))


def match_files(pos: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``file`` to records: the first path whose stem is the record's name, else whose base name is."""
    base = F.element_at(F.split(F.col("path"), r"[/\\]"), -1)
    stems = files.select("path", F.regexp_replace(base, r"\.[^.]*$", "").alias("stem")).groupBy("stem").agg(F.min("path").alias("by_stem"))
    names = files.select("path", base.alias("base")).groupBy("base").agg(F.min("path").alias("by_base"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    joined = pos.join(stems, stem == F.col("stem"), "left").join(names, F.col("name") == F.col("base"), "left")
    return joined.withColumn("file", F.coalesce("by_stem", "by_base", "name")).drop("stem", "by_stem", "base", "by_base")


def move_plan(kept: DataFrame, files: DataFrame, root: str, target: str) -> DataFrame:
    """Where removed images would go, below ``target`` by their path relative to ``root``; nothing is moved."""
    gone = kept.where("not keep").select("idx").join(files, "idx")
    relative = F.when(F.col("path").startswith(root), F.expr("substring(path, {})".format(len(root.rstrip("/")) + 2))).otherwise(F.element_at(F.split("path", "/"), -1))
    return gone.select("idx", F.col("path").alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), relative).alias("destination"))
