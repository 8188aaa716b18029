"""Point clouds: voxels, ground, normalising, sampling, blocks, classes.

A cloud has ``idx`` (its order), ``x, y, z``, ``r, g, b`` (0 to 1, null without
colour) and ``label``; several clouds are told apart by ``scene``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.config import ClassifyConfig
from skyquilt.functions import colour, draws
from skyquilt.operators.neighbours import nearest_cell
from skyquilt.operators.numbering import numbered
from skyquilt.operators.quantiles import exact_quantiles
from skyquilt.storage import Scratch

KEY = ["kx", "ky", "kz"]
AXES = ("x", "y", "z")


def with_voxel(points: DataFrame, size: float, origin: str = "absolute") -> DataFrame:
    """Adds the voxel's three whole numbers; origin: 'absolute' (multiples of the size) or 'min' (from the cloud's lower corner, one row sent along)."""
    if origin == "absolute":
        return points.withColumns({f"k{a}": F.floor(F.col(a) / size) for a in AXES})
    corner = points.agg(*[F.min(a).alias(f"_{a}0") for a in AXES])
    keyed = points.crossJoin(F.broadcast(corner))
    return keyed.withColumns({f"k{a}": F.floor((F.col(a) - F.col(f"_{a}0")) / size) for a in AXES}).drop(*[f"_{a}0" for a in AXES])


def voxel_mean(points: DataFrame, size: float) -> DataFrame:
    """A point for each voxel: mean place and colour, most frequent label (the smallest of several)."""
    return with_voxel(points, size).groupBy(*KEY).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b")], F.mode("label", True).alias("label")
    )


def voxel_first(points: DataFrame, size: float) -> DataFrame:
    """The first point (by ``idx``) of each voxel.

    Each column is that of the least ``idx``, kept by a hash aggregate as points
    are read, so a task hands on a row for each of its voxels and nothing is
    joined back.
    """
    rest = [c for c in points.columns if c not in (*KEY, "idx")]
    return with_voxel(points, size, "min").groupBy(*KEY).agg(F.min("idx").alias("idx"), *[F.min_by(c, "idx").alias(c) for c in rest])


def voxel_moments(points: DataFrame, size: float, origin: str = "min") -> DataFrame:
    """Number of points and population covariances of each voxel."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return with_voxel(points, size, origin).groupBy(*KEY).agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


TIE = 1e-9  # eigenvalues this close, as a share of the largest, are one


def _dot(*pairs: tuple[str, str]) -> str:
    return " + ".join(f"{a} * {b}" for a, b in pairs)


def voxel_shape(moments: DataFrame) -> DataFrame:
    """Adds planarity, roughness and verticality from the eigenvalues and the normal of each voxel's covariance.

    The 3 x 3 matrix is solved in closed form: of its eigenvalues, roots of a cubic,
    the one that stands apart from the other two is taken, with the cross product
    of two rows as its vector; the other two are those of the 2 x 2 matrix across
    it.  So no digits are lost where two are nearly equal, as in a voxel of two
    points.  Where the two smallest are equal, the most vertical of their vectors
    is the normal.  A voxel of one point, or as wide in all directions, has no
    normal: verticality 1 (of one point planarity and roughness are 0).
    """
    rows = (("_xx", "cxy", "cxz"), ("cxy", "_yy", "cyz"), ("cxz", "cyz", "_zz"))
    cross = lambda i, j: [f"{rows[i][b]} * {rows[j][c]} - {rows[i][c]} * {rows[j][b]}" for b, c in ((1, 2), (2, 0), (0, 1))]
    form = lambda u, v: f"cxx * {u}0 * {v}0 + cyy * {u}1 * {v}1 + czz * {u}2 * {v}2 + cxy * ({u}0 * {v}1 + {u}1 * {v}0) + cxz * ({u}0 * {v}2 + {u}2 * {v}0) + cyz * ({u}1 * {v}2 + {u}2 * {v}1)"
    pairs = ((0, 1), (0, 2), (1, 2))
    steps = [
        {"_q": "(cxx + cyy + czz) / 3", "_off": _dot(("cxy", "cxy"), ("cxz", "cxz"), ("cyz", "cyz"))},
        {"_p": f"sqrt(({_dot(*[(f'(c{a}{a} - _q)', f'(c{a}{a} - _q)') for a in 'xyz'])} + 2 * _off) / 6)"},
        {"_round": f"_p <= {TIE} * _q or _q <= 0", "_div": "greatest(_p, 1e-300)"},
        {f"_{a}": f"(c{a[0]}{a[1]}{' - _q' if a[0] == a[1] else ''}) / _div" for a in ("xx", "xy", "xz", "yy", "yz", "zz")},
        {"_r": "least(1.0, greatest(-1.0, (_xx * (_yy * _zz - _yz * _yz) - _xy * (_xy * _zz - _yz * _xz) + _xz * (_xy * _yz - _yy * _xz)) / 2))"},
        {"_top": "_r >= 0"},  # the largest stands apart, else the smallest
        {"_e": "_q + 2 * _p * cos((acos(_r) + if(_top, 0, 2 * pi())) / 3)"},
        {f"_{a}{a}": f"c{a}{a} - _e" for a in "xyz"},
        {f"_c{i}{j}{k}": e for i, j in pairs for k, e in enumerate(cross(i, j))},
        {f"_n{i}{j}": _dot(*[(f"_c{i}{j}{k}", f"_c{i}{j}{k}") for k in range(3)]) for i, j in pairs},
        {"_n": "greatest(_n01, _n02, _n12)"},
        {f"_w{k}": f"case when _n01 = _n then _c01{k} when _n02 = _n then _c02{k} else _c12{k} end / sqrt(greatest(_n, 1e-300))" for k in range(3)},
        {"_flat": "abs(_w0) > abs(_w1)"},
        {"_len": "greatest(sqrt(if(_flat, _w0 * _w0, _w1 * _w1) + _w2 * _w2), 1e-300)"},
        {"_u0": "if(_flat, -_w2 / _len, 0.0)", "_u1": "if(_flat, 0.0, _w2 / _len)", "_u2": "if(_flat, _w0, -_w1) / _len"},
        {f"_v{k}": f"_w{a} * _u{b} - _w{b} * _u{a}" for k, (a, b) in enumerate(((1, 2), (2, 0), (0, 1)))},
        {"_m00": form("_u", "_u"), "_m01": form("_u", "_v"), "_m11": form("_v", "_v")},
        {"_mid": "(_m00 + _m11) / 2", "_half": "sqrt((_m00 - _m11) * (_m00 - _m11) / 4 + _m01 * _m01)"},
        {"_low": "_mid - _half", "_high": "_mid + _half"},
        {"_e0": "if(_top, _low, _e)", "_e1": "if(_top, _high, _low)", "_e2": "if(_top, _e, _high)"},
        {"_e0": f"if(_round, _q, if(_e0 <= {TIE} * {TIE} * _e2, 0.0, _e0))", "_e1": f"if(_round, _q, if(_e1 <= {TIE} * {TIE} * _e2, 0.0, _e1))", "_e2": "if(_round, _q, _e2)"},
        # the vector of the smaller eigenvalue across _w
        {"_a0": "if(abs(_low - _m00) > abs(_low - _m11), _m01, _low - _m11)", "_a1": "if(abs(_low - _m00) > abs(_low - _m11), _low - _m00, _m01)"},
        {"_nz": f"case when _round then 0.0 when _e1 - _e0 <= {TIE} * _e2 then sqrt(greatest(0.0, 1 - _w2 * _w2)) when not _top then abs(_w2) else abs(_a0 * _u2 + _a1 * _v2) / greatest(sqrt(_a0 * _a0 + _a1 * _a1), 1e-300) end"},
        {"planarity": "(_e1 - _e0) / greatest(_e2, 1e-12)", "roughness": "sqrt(greatest(_e0, 0.0))", "verticality": "1 - least(1.0, _nz)"},
    ]
    solved = reduce(lambda df, step: df.withColumns({k: F.expr(e) for k, e in step.items()}), steps, moments)
    return solved.select(*moments.columns, "planarity", "roughness", "verticality")


def ground_cells(points: DataFrame, cell: float, quantile: float, min_points: int) -> DataFrame:
    """``ix, iy, n, ground``: a low quantile of z in each cell with enough points, else null."""
    keyed = points.select(F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy"), "z")
    cells = keyed.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.percentile("z", F.lit(quantile)).alias("q"))
    return cells.select("ix", "iy", "n", F.when(F.col("n") >= min_points, F.col("q")).alias("ground"))


def height_above_ground(points: DataFrame, cell: float = 1.0, quantile: float = 0.05, min_points: int = 5) -> DataFrame:
    """Adds ``ground`` and ``height``; a cell with too few points takes the ground of the nearest good cell (ties: smallest ix, iy)."""
    cells = ground_cells(points, cell, quantile, min_points)
    good = cells.where("ground is not null").select("ix", "iy", "ground")
    filled = nearest_cell(cells.where("ground is null").select("ix", "iy"), good).union(good)
    keyed = points.withColumn("ix", F.floor(F.col("x") / cell)).withColumn("iy", F.floor(F.col("y") / cell))
    return keyed.join(filled, ["ix", "iy"], "left").withColumn("height", F.col("z") - F.col("ground"))


def class_rules(config: ClassifyConfig = ClassifyConfig()) -> Column:
    """The class of a point by the first rule that holds; needs r, g, b, height, planarity, roughness and verticality.

    0 unclassified, 1 building, 2 road, 3 vegetation, 4 bare ground, 5 other man-made.
    """
    c, (r, g, b) = config, map(F.col, "rgb")
    h, plan, rough, vert = map(F.col, ("height", "planarity", "roughness", "verticality"))
    exg, dom, bright, sat = colour.excess_green(r, g, b), colour.green_dominance(r, g, b), colour.brightness(r, g, b), colour.saturation(r, g, b)
    green = (exg > c.green_exg) & (dom > c.green_dominance)
    tree = (h > c.tree_height) & (exg > c.tree_exg) & (rough > c.tree_roughness)
    roof = (plan > c.roof_planarity) & (rough < c.roof_roughness)
    wall = (vert > c.wall_verticality) & (sat < c.wall_saturation)
    low = h <= c.ground_height
    road = (bright < c.road_brightness) & (rough < c.road_roughness) & (sat < c.road_saturation)
    soil = (r - g > c.soil_red_excess) & (bright > c.soil_brightness)
    return F.when(green | tree, 3).when((h > c.building_height) & (roof | wall), 1).when(low & road, 2).when(low & soil, 4).when(low | (h > c.other_height), 5).otherwise(0)


def classify(points: DataFrame, config: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """Adds height, the voxel's shape and the class to every point: one join with the ground cells, one with the voxels."""
    c = config
    high = height_above_ground(points, c.ground_cell, c.ground_percentile, c.ground_min_points)
    shape = voxel_shape(voxel_moments(points, c.voxel)).select(*KEY, "planarity", "roughness", "verticality")
    return with_voxel(high, c.voxel, "min").join(shape, KEY, "left").withColumn("class", class_rules(c)).drop(*KEY)


def feature_quantiles(points: DataFrame, columns: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """``feature, q, value`` with exact quantiles (see ``exact_quantiles``, which runs its passes at once)."""
    found = exact_quantiles(points, columns, quantiles)
    return points.sparkSession.createDataFrame([(c, float(q), v) for c in columns for q, v in zip(quantiles, found[c], strict=True)], "feature string, q double, value double")


def class_counts(points: DataFrame, classes: int, column: str = "label") -> DataFrame:
    """``label, n, percent`` of every class of the domain, absent ones with 0; the domain is sent along."""
    total = points.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    all_of = points.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    counted = all_of.join(total, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.sum("n").over(Window.partitionBy())  # a row for each class
    return counted.select("label", "n", F.round(F.when(whole > 0, F.col("n") * 100.0 / whole).otherwise(0.0), 6).alias("percent"))


def class_report(points: DataFrame, classes: int, features: Sequence[str], parameters: dict[str, object], column: str = "class") -> DataFrame:
    """The lines of a classification report: ``part, place, line``.

    Parts: 'class' (number and percent of every class), 'feature' (quantiles of
    each feature) and 'parameter' (sorted by name).
    """
    quantiles = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    counts = class_counts(points, classes, column)
    shown = counts.select(F.lit("class").alias("part"), F.col("label").alias("place"), F.format_string("%d: %d (%.2f%%)", "label", "n", "percent").alias("line"))
    found = exact_quantiles(points, features, quantiles)
    lines = [("feature", i, f"{c}: " + ", ".join("null" if v is None else f"{v:.4f}" for v in found[c])) for i, c in enumerate(features)]
    rows = points.sparkSession.createDataFrame(lines, "part string, place int, line string")
    given = points.sparkSession.createDataFrame([("parameter", i, f"{k}={v}") for i, (k, v) in enumerate(sorted(parameters.items()))], "part string, place int, line string")
    return shown.union(rows).union(given)


def block_classes(blocked: DataFrame, classes: int, column: str = "label") -> DataFrame:
    """``bx, by, points`` of every block and ``n0 ..`` and ``ratio0 ..`` of every class in it."""
    counts = blocked.groupBy("bx", "by").agg(F.count("*").alias("points"), *[F.count_if(F.col(column) == k).alias(f"n{k}") for k in range(classes)])
    return counts.select("bx", "by", "points", *[f"n{k}" for k in range(classes)], *[(F.col(f"n{k}") / F.col("points")).alias(f"ratio{k}") for k in range(classes)])


def normalise(points: DataFrame, scene: str = "scene") -> DataFrame:
    """Adds ``nx, ny, nz``: each scene about its centroid and within the unit ball (a scene of no extent is only moved); and the values to go back."""
    centre = points.groupBy(scene).agg(*[F.avg(a).alias(f"m{a}") for a in AXES])
    moved = points.join(centre, scene)
    reach = moved.groupBy(scene).agg(F.max(F.sqrt(reduce(lambda p, q: p + q, [(F.col(a) - F.col(f"m{a}")) ** 2 for a in AXES]))).alias("reach"))
    unit = F.when(F.col("reach") > 0, F.col("reach")).otherwise(1.0)
    return moved.join(reach, scene).withColumns({f"n{a}": (F.col(a) - F.col(f"m{a}")) / unit for a in AXES})


def feature_vector(points: DataFrame, with_colour: bool) -> DataFrame:
    return points.withColumn("features", F.array(*[F.col(c).cast("float") for c in ("x", "y", "z", "r", "g", "b")[: 6 if with_colour else 3]]))


def augment(points: DataFrame, seed: int, scene: str = "scene") -> DataFrame:
    """A turn about z and a scale for each scene, jitter for each point and channel.

    All draws are hashes of the seed and of the scene or the point (``idx``), so
    they follow the seed and nothing else, neither partitions nor row order.
    """
    turn, scale = draws.unit(seed, 1, F.col(scene)) * 2 * np.pi, 0.9 + 0.2 * draws.unit(seed, 2, F.col(scene))
    jitter = lambda k: 0.01 * draws.normal(seed, 100 + k, F.col(scene), F.col("idx"))
    x, y, z = map(F.col, AXES)
    moved = points.withColumns({"x": scale * (x * F.cos(turn) - y * F.sin(turn)) + jitter(0), "y": scale * (x * F.sin(turn) + y * F.cos(turn)) + jitter(1), "z": scale * z + jitter(2)})
    return moved.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + jitter(3 + i))) for i, c in enumerate("rgb")})


def order_key(seed: int) -> Column:
    """A seeded order of points that any engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string")))


def sample_by_class(points: DataFrame, per_class: int, seed: int) -> DataFrame:
    """At most ``per_class`` points of each label, without replacement."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order_key(seed), "idx"))
    return points.withColumn("rank", rank).where(F.col("rank") <= per_class).drop("rank")


def sample_to(points: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` points: without replacement if there are enough, else all of them drawn with replacement by position."""
    have = points.count()
    if have >= n or not have:
        return points.orderBy(order_key(seed), "idx").limit(n)
    place = numbered(Scratch(points.sparkSession), points, ["idx"], "_at")
    drawn = points.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(have)).alias("_at"))
    return drawn.join(place, "_at").drop("_at")


def gather(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``points`` by the ``idx`` of ``wanted``, repeats kept."""
    return wanted.join(points, "idx")


def with_predictions(points: DataFrame, predictions: DataFrame) -> DataFrame:
    """Points with the prediction of the same position: both have ``idx``, their order.

    Tables that do not have the same positions are an error: one row of counts
    says so before anything is joined.
    """
    both = points.select("idx", F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(predictions.select("idx", F.lit(0).alias("p"), F.lit(1).alias("q")))
    found = both.groupBy("idx").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).agg(F.sum("p"), F.sum("q"), F.count_if(F.expr("p <> 1 or q <> 1"))).first()
    if found[2]:
        raise ValueError(f"{found[0]} points and {found[1]} predictions, {found[2]} positions that are not one of each")
    return points.join(predictions, "idx")


def blocks(points: DataFrame, size: float, overlap: float = 0.0, min_points: int = 100) -> DataFrame:
    """Points with the blocks they lie in (``bx, by``); blocks of few points are left out, and so are points on the upper edge.

    Block origins run from the lower corner in steps of size * (1 - overlap);
    a point's blocks are counted out, so overlap costs copies and no join.
    """
    stride = size * (1.0 - overlap)
    corner = points.agg(*[f(a).alias(f"_{a}{i}") for a in ("x", "y") for i, f in enumerate((F.min, F.max))])
    cut = points.crossJoin(F.broadcast(corner))

    def indexes(a: str) -> Column:
        low, high = F.col(f"_{a}0"), F.col(f"_{a}1")
        count = F.ceil((high - low) / stride)
        # a quotient may round to the other side of a whole number, so one more on either side is tried against the edges
        last = F.least(F.floor((F.col(a) - low) / stride) + 1, count - 1)
        first = F.greatest(F.floor((F.col(a) - low - size) / stride), F.lit(0))
        some = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
        return F.filter(some, lambda i: (F.col(a) >= low + i * stride) & (F.col(a) < low + i * stride + size))

    cut = cut.withColumn("bx", F.explode(indexes("x"))).withColumn("by", F.explode(indexes("y"))).drop("_x0", "_x1", "_y0", "_y1")
    full = cut.groupBy("bx", "by").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)
    return cut.join(full, ["bx", "by"])


def split_blocks(blocked: DataFrame, val_ratio: float = 0.15, test_ratio: float = 0.15, seed: int = 0) -> DataFrame:
    """``bx, by, file, split`` of each block: a seeded shuffle of the block list, then val, test and train.

    Blocks get their places in the list from counts of ranges.  The shuffle needs
    no more than their number: a task draws it (8 bytes a block) and hands it on as
    rows, so the list is in neither the driver nor a task.
    """
    scratch = Scratch(blocked.sparkSession)
    listed, seen = scratch.save_counted(blocked.select("bx", "by").distinct(), n=F.count("*"))
    n = seen["n"]
    placed = numbered(scratch, listed, ["bx", "by"], "place")

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            places = np.random.default_rng(seed).permutation(n)
            for at in range(0, n, 100_000):
                some = places[at : at + 100_000]
                yield pd.DataFrame({"place": some, "file": np.arange(at, at + len(some))})

    order = blocked.sparkSession.range(0, 1, 1, 1).mapInPandas(drawn, "place long, file int")
    n_val, n_test = int(n * val_ratio), int(n * test_ratio)
    split = F.when(F.col("file") < n_val, "val").when(F.col("file") < n_val + n_test, "test").otherwise("train")
    return placed.join(order, "place").select("bx", "by", "file", split.alias("split"))


def concat_scenes(parts: Sequence[DataFrame]) -> DataFrame:
    """All clouds as one; colours stay only if every point has them."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    coloured = whole.agg((F.count("*") == F.count("r")).alias("_all"))
    return whole.crossJoin(F.broadcast(coloured)).withColumns({c: F.when(F.col("_all"), F.col(c)) for c in "rgb"}).drop("_all")
