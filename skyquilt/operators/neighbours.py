"""Neighbour joins over a grid of buckets: within a radius, k nearest, nearest cell.

A theta join would compare all pairs.  Here points meet only those of their own
and the adjoining buckets, by equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.operators.numbering import numbered
from skyquilt.storage import Scratch, saved


def _squared(a: str, b: str, axes: Sequence[str]) -> Column:
    return reduce(lambda p, q: p + q, [(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in axes])


def _meet(queries: DataFrame, points: DataFrame, size: float, axes: Sequence[str]) -> DataFrame:
    """Pairs ``src, dst, d2`` within one bucket of each other."""
    width = F.lit(float(size))
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"s{c}") for s, c in zip(shift, axes, strict=True)]) for shift in product((-1, 0, 1), repeat=len(axes))])
    q = queries.withColumn("_s", F.explode(steps)).select(F.col("idx").alias("src"), *axes, *[(F.floor(F.col(c) / width) + F.col(f"_s.s{c}")).alias(f"k{c}") for c in axes])
    p = points.select(F.col("idx").alias("dst"), *axes, *[F.floor(F.col(c) / width).alias(f"k{c}") for c in axes])
    on = reduce(lambda a, b: a & b, [F.col(f"q.k{c}") == F.col(f"p.k{c}") for c in axes])
    return q.alias("q").join(p.alias("p"), on).select("src", "dst", _squared("q", "p", axes).alias("d2"))


def radius_pairs(points: DataFrame, eps: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """All pairs ``src, dst, d2`` within ``eps``, a point with itself included."""
    return _meet(points, points, eps, axes).where(F.col("d2") <= eps * eps)


SPLIT, FEW = 4, 4096  # sub-cells on an axis of the cell above; pairs of points that are looked at one by one


def radius_counts(points: DataFrame, eps: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``idx, degree``: how many points lie within ``eps`` of each, itself included, without listing the pairs.

    Cells that adjoin are compared by the boxes of their points: if all are near
    each other, the count of one is added to every point of the other, if none
    can be, nothing is.  Pairs of cells in between are split into sub-cells, until
    they are ``FEW`` pairs of points, which are looked at.  So a crowd costs the
    sub-cells at the rim of the radius and not its square.  A place that is not
    finite has no row; rows of the same ``idx`` are points each.
    """
    scratch, limit = Scratch(points.sparkSession), eps * eps
    own = scratch.save(points.where(finite(axes)).select(F.monotonically_increasing_id().alias("id"), "idx", *[F.col(c).cast("double").alias(c) for c in axes]))
    cell = lambda level: [F.floor(F.col(c) / (eps / SPLIT**level)).alias(f"k{c}") for c in axes]
    keys = [f"k{c}" for c in axes]
    side = lambda s: [f"{s}{k}" for k in keys]
    shifts = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"s{c}") for s, c in zip(shift, axes, strict=True)]) for shift in product((-1, 0, 1), repeat=len(axes))])).alias("s")
    there = own.select(*cell(0)).distinct()
    a = there.select(*[F.col(k).alias(f"a{k}") for k in keys], shifts).select(*side("a"), *[(F.col(f"ak{c}") + F.col(f"s.s{c}")).alias(f"bk{c}") for c in axes])
    near = a.join(there.select(*[F.col(k).alias(f"b{k}") for k in keys]), side("b"))
    level, sums = 0, None
    while True:
        placed = own.select("id", *axes, *cell(level), *[F.floor(F.col(c) / (eps / SPLIT ** (level + 1))).alias(f"t{c}") for c in axes])
        boxes = placed.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{s}{c}") for c in axes for s, f in (("l", F.min), ("h", F.max))])
        of = lambda t: boxes.select(*[F.col(c).alias(f"{t}{c}") for c in boxes.columns])
        met = near.join(of("a"), side("a")).join(of("b"), side("b"))
        gap = [F.greatest(F.col(f"al{c}") - F.col(f"bh{c}"), F.col(f"bl{c}") - F.col(f"ah{c}"), F.lit(0.0)) for c in axes]
        span = [F.greatest(F.col(f"ah{c}") - F.col(f"bl{c}"), F.col(f"bh{c}") - F.col(f"al{c}")) for c in axes]
        square = lambda parts: reduce(lambda p, q: p + q, [x * x for x in parts])
        met = met.where(square(gap) <= limit).select(*side("a"), *side("b"), "bn", (square(span) <= limit).alias("all"), (F.col("an") * F.col("bn") <= FEW).alias("few"))
        met, seen = scratch.save_counted(met, n=F.count_if(F.expr("not few and not all")))
        whole = met.where("all").groupBy(*side("a")).agg(F.sum("bn").alias("n"))
        added = placed.join(whole, [F.col(k) == F.col(f"a{k}") for k in keys]).select("id", "n")
        few = met.where("few and not all").select(*side("a"), *side("b"))
        p = lambda t: placed.select(F.col("id").alias(f"{t}id"), *[F.col(c).alias(f"{t}{c}") for c in axes], *[F.col(k).alias(f"{t}{k}") for k in keys])
        pairs = few.join(p("a"), side("a")).join(p("b"), side("b")).where(square([F.col(f"a{c}") - F.col(f"b{c}") for c in axes]) <= limit)
        found = added.unionByName(pairs.groupBy(F.col("aid").alias("id")).agg(F.count("*").alias("n")))
        sums = found if sums is None else sums.unionByName(found)
        if not seen["n"]:
            return sums.groupBy("id").agg(F.sum("n").alias("degree")).join(own.select("id", "idx"), "id").select("idx", "degree")
        rest = met.where("not few and not all").select(*side("a"), *side("b"))
        below = placed.select(*keys, *[f"t{c}" for c in axes]).distinct()
        child = lambda t: below.select(*[F.col(k).alias(f"{t}{k}") for k in keys], *[F.col(f"t{c}").alias(f"{t}t{c}") for c in axes])
        made = rest.join(child("a"), side("a")).join(child("b"), side("b")).select(*[F.col(f"{t}t{c}").alias(f"{t}k{c}") for t in "ab" for c in axes]).distinct()
        near, level = scratch.save(made), level + 1


PER_LEAF, PER_BLOCK, FAN = 16, 32, 16  # points of a leaf at least, queries of a block, children of a node
SLACK = 1 + 1e-9  # bounds and distances are rounded differently
PER_TASK = 1_000_000  # rows that a task makes of those it reads, by estimate


class Curve:
    """Order of places along a Z-curve through a box; places outside are put at its edge."""

    def __init__(self, axes: Sequence[str], lows: Sequence[float], highs: Sequence[float]):
        self.axes, self.lows, self.bits = axes, lows, min(30, 60 // len(axes))
        self.width = max(*(h - low for low, h in zip(lows, highs, strict=True)), 0.0) / 2**self.bits or 1.0

    def code(self, df: DataFrame) -> DataFrame:
        """Adds ``_z``: the bits of the cell's numbers, one axis after the other."""
        top, d = 2**self.bits - 1, len(self.axes)
        cells = [F.least(F.greatest(F.floor((F.col(c) - low) / self.width), F.lit(0)), F.lit(top)).cast("long").alias(f"_c{i}") for i, (c, low) in enumerate(zip(self.axes, self.lows, strict=True))]
        bits = " | ".join(f"shiftleft(shiftright(_c{i}, {b}) & 1, {b * d + i})" for b in range(self.bits) for i in range(d))
        return df.select("*", *cells).select(*df.columns, F.expr(bits).alias("_z"))


def _tasks(rows: int) -> int:
    """Into how many parts rows are dealt before a join makes ``rows`` of them; Spark itself deals by the few bytes that it reads."""
    return max(1, -(-rows // PER_TASK))


def finite(axes: Sequence[str]) -> Column:
    """Whether a place has a number on each axis."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in axes])


def _box(axes: Sequence[str], prefix: str) -> list[Column]:
    return [f(c).alias(f"{prefix}{side}{c}") for c in axes for side, f in (("l", F.min), ("h", F.max))]


def _least(axes: Sequence[str], low: str, high: str) -> Column:
    """The least squared distance from a box (or place) to the box ``n``."""
    gaps = [F.greatest(F.col(f"nl{c}") - F.col(f"{high}{c}"), F.col(f"{low}{c}") - F.col(f"nh{c}"), F.lit(0.0)) for c in axes]
    return reduce(lambda a, b: a + b, [g * g for g in gaps])


def _most(axes: Sequence[str]) -> Column:
    """The largest squared distance from the box ``q`` to the box ``n``."""
    spans = [F.greatest(F.col(f"qh{c}") - F.col(f"nl{c}"), F.col(f"nh{c}") - F.col(f"ql{c}")) for c in axes]
    return reduce(lambda a, b: a + b, [s * s for s in spans])


def _tree(scratch: Scratch, placed: DataFrame, k: int, n: int, per_leaf: int, axes: Sequence[str], within: Sequence[str]) -> list[DataFrame]:
    """Levels of nodes (``within, id, n`` and their boxes), leaves first: runs of points on the curve, then runs of ``FAN`` nodes."""
    leaves = placed.groupBy(*within, "id").agg(F.count("*").alias("n"), *_box(axes, "n"))
    # of leaves that lie in one spot the first holds the points that come first there, all that a search can ask for
    spot = reduce(lambda a, b: a & b, [F.col(f"nl{c}") == F.col(f"nh{c}") for c in axes]) & (F.col("n") == per_leaf)
    names = [f"n{s}{c}" for c in axes for s in "lh"]
    spots = leaves.where(spot).groupBy(*within, *names).agg(F.min("id").alias("id")).withColumn("n", F.lit(per_leaf).cast("long"))
    levels, most = [scratch.save(leaves.where(~spot).unionByName(spots))], -(-n // per_leaf)
    while most > 1:
        up = F.floor(F.col("id") / FAN).alias("id")
        levels.append(levels[-1].groupBy(*within, up).agg(F.sum("n").alias("n"), *[f(f"n{s}{c}").alias(f"n{s}{c}") for c in axes for s, f in (("l", F.min), ("h", F.max))]))
        most = -(-most // FAN)
    return levels


def knn(queries: DataFrame, points: DataFrame, k: int, axes: Sequence[str] = ("x", "y", "z"), *, keep: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """``src, dst, d2, rank`` (and ``keep``): the k nearest points of every query, ties by ``idx``, a point itself included; only points alike in ``within`` count.

    Points are put in order along a Z-curve; a run of them is a leaf with its box,
    a run of leaves a node, and so on.  Queries in a run are a block with its box.
    All blocks go down the tree together, a join a level: a node is opened only if
    its least distance to the block is within the least bound that any node with
    k points sets by its largest distance.  At the leaves each query takes its
    own bound from the k-th point of the best leaf, and meets the points of the
    leaves within it.  So there are as many steps as levels, wherever a query
    lies, and leaves hold as many points in a crowd as in empty space; of a spot
    with more copies of a point than a leaf holds, one leaf is kept.

    A place with a null, NaN or infinite coordinate has no neighbours and is none;
    a query without points to find has no row.  Queries of the same ``idx`` are
    queries each.
    """
    scratch = Scratch(points.sparkSession)
    box = points.where(finite(axes)).agg(F.count("*").alias("n"), *_box(axes, "")).first()
    n = box["n"]
    if not n:
        raise ValueError("no points to search")
    k = min(k, n)
    curve = Curve(axes, [box[f"l{c}"] for c in axes], [box[f"h{c}"] for c in axes])
    per_leaf = max(PER_LEAF, 2 * k)
    order = [*within, "_z", *axes, "idx"]
    of_points = numbered(scratch, curve.code(points.where(finite(axes)).select("idx", *axes, *within, *keep)), order, "_at")
    placed = of_points.select("*", F.floor(F.col("_at") / per_leaf).alias("id"))
    levels = _tree(scratch, placed, k, n, per_leaf, axes, within)

    of_queries = of_points if queries is points else numbered(scratch, curve.code(queries.where(finite(axes)).select("idx", *axes, *within)), order, "_at")
    # a block does not reach beyond a cell that holds some hundred points on average, so strangers are blocks of their own
    coarse = len(axes) * max(0, curve.bits - int(log2(max(1.0, n / (8 * PER_BLOCK))) / len(axes)))
    asked = of_queries.select(F.col("_at").alias("_q"), F.col("idx").alias("src"), *axes, *within, F.floor(F.col("_at") / PER_BLOCK).alias("_b"), F.shiftright("_z", coarse).alias("_c"))
    block = ["_b", "_c", *within]
    asking = n if queries is points else of_queries.count()
    front = asked.repartition(_tasks(asking * FAN), *block).groupBy(*block).agg(*_box(axes, "q")).select("*", F.lit(0).cast("long").alias("id"), F.lit(float("inf")).alias("bound"))
    kept_front = [*block, *[f"q{s}{c}" for c in axes for s in "lh"]]
    for level in reversed(levels[:-1] if len(levels) > 1 else levels):
        below = level.select(*within, F.floor(F.col("id") / FAN).alias("id"), F.col("id").alias("child"), "n", *[f"n{s}{c}" for c in axes for s in "lh"])
        met = front.join(below, [*within, "id"]).withColumns({"least": _least(axes, "ql", "qh"), "most": _most(axes)})
        bound = F.least("bound", F.min(F.when(F.col("n") >= k, F.col("most"))).over(Window.partitionBy(*block)))
        met = met.withColumn("bound", bound).where(F.col("least") <= F.col("bound") * SLACK)
        front = met.select(*kept_front, F.col("child").alias("id"), "bound", "most", "n", *[f"n{s}{c}" for c in axes for s in "lh"])
        if level is not levels[0]:
            front = front.drop("most", "n", *[f"n{s}{c}" for c in axes for s in "lh"])
    front = scratch.save(front)
    scratch.drop(levels[0])

    best = front.where(F.col("n") >= k).groupBy(*block).agg(F.min_by("id", "most").alias("id"))
    listed = placed.select(F.col("idx").alias("dst"), *axes, *keep, *within, "id")

    def meet(q: DataFrame, rows: int) -> DataFrame:
        by, tasks = [*within, "id"], _tasks(rows * per_leaf)
        on = reduce(lambda a, b: a & b, [F.col(f"q.{c}") == F.col(f"p.{c}") for c in by])
        return q.repartition(tasks, *by).alias("q").join(listed.repartition(tasks, *by).alias("p"), on).withColumn("d2", _squared("q", "p", axes))

    # a leaf's points, so a short list
    bounds = meet(asked.join(best, block), asking).groupBy("_q").agg(F.get(F.array_sort(F.collect_list("d2")), F.lit(k - 1)).alias("reach"))
    bounded = asked.join(bounds, "_q", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))) * SLACK)
    opened = bounded.join(front, block).where(_least(axes, "", "") <= F.col("reach"))
    opened, seen = scratch.save_counted(opened.select("_q", "src", "reach", *axes, *within, "id"), n=F.count("*"))
    scratch.drop(front)
    near = meet(opened, seen["n"]).where(F.col("d2") <= F.col("reach"))
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("d2", "dst"))
    return near.select("_q", "src", "dst", "d2", *[F.col(f"p.{c}").alias(c) for c in keep]).withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "d2", "rank", *keep)


def mean_distance(points: DataFrame, k: int = 16, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """``idx, mean_dist`` to the k nearest others."""
    near = knn(points, points, k + 1, axes).where("rank > 1")
    return near.groupBy(F.col("src").alias("idx")).agg(F.avg(F.sqrt("d2")).alias("mean_dist"))


def outlier_flags(points: DataFrame, k: int = 16, std_ratio: float = 2.0) -> DataFrame:
    """Adds ``mean_dist`` and ``keep``: not farther from its neighbours than the mean of all and ``std_ratio`` deviations; only the upper side is cut."""
    dist = saved(mean_distance(points, k))
    limit = dist.agg((F.avg("mean_dist") + std_ratio * F.stddev_pop("mean_dist")).alias("limit"))
    return dist.crossJoin(F.broadcast(limit)).withColumn("keep", F.col("mean_dist") <= F.col("limit")).drop("limit")


def nearest(queries: DataFrame, points: DataFrame, keep: Sequence[str], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The nearest point of every query, with its columns ``keep``."""
    return knn(queries, points, 1, axes, keep=keep).select(F.col("src").alias("idx"), F.col("dst").alias("nearest"), "d2", *keep)


def nearest_cell(holes: DataFrame, good: DataFrame) -> DataFrame:
    """``ix, iy, ground`` of cells without ground: that of the nearest cell with it, ties by (ix, iy); null if there is none."""
    if good.isEmpty():
        return holes.withColumn("ground", F.lit(None).cast("double"))
    cell = lambda df, *more: df.select(F.struct("ix", "iy").alias("idx"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), *more)
    return knn(cell(holes), cell(good, "ground"), 1, ("x", "y"), keep=["ground"]).select("src.ix", "src.iy", "ground")


def multi_scale_max(edges: DataFrame, points: DataFrame, columns: Sequence[str], scales: Sequence[int] = (8, 16, 32)) -> DataFrame:
    """Per point the largest value of each column among its K nearest, for several K: one pass over the edges of the largest K."""
    values = points.select(F.col("idx").alias("dst"), *columns)
    joined = edges.join(values, "dst")
    return joined.groupBy(F.col("src").alias("idx")).agg(*[F.max(F.when(F.col("rank") <= k, F.col(c))).alias(f"{c}_max{k}") for k in scales for c in columns])


def attention_pool(edges: DataFrame, points: DataFrame, score: str, value: str) -> DataFrame:
    """Per point the mean of its neighbours' values, weighted by the softmax of their scores."""
    joined = edges.join(points.select(F.col("idx").alias("dst"), F.col(score).alias("s"), F.col(value).alias("v")), "dst")
    top = joined.groupBy("src").agg(F.max("s").alias("top"))
    weighed = joined.join(top, "src").withColumn("w", F.exp(F.col("s") - F.col("top")))
    return weighed.groupBy(F.col("src").alias("idx")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("pooled"))


def local_geometry(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Per (point, neighbour): centre, neighbour, their difference and distance, ten numbers."""
    p = points.select(F.col("idx").alias("src"), *[F.col(c).alias(f"c{c}") for c in "xyz"])
    q = points.select(F.col("idx").alias("dst"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    difference = {f"d{c}": F.col(f"c{c}") - F.col(f"n{c}") for c in "xyz"}
    return edges.select("src", "dst", "rank", F.sqrt("d2").alias("dist")).join(p, "src").join(q, "dst").withColumns(difference)
