"""Density clusters in the plane and the targets made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.operators.graph import components
from skyquilt.operators.neighbours import finite
from skyquilt.operators.numbering import numbered
from skyquilt.storage import Scratch


def dbscan(points: DataFrame, eps: float = 2.0, min_samples: int = 20, border_rule: str = "scan_order") -> DataFrame:
    """``idx, cluster``: density clusters over x and y, -1 for noise.

    A core point has ``min_samples`` points within ``eps``, itself counted.
    Clusters are the components of the core points, numbered by their first
    point.  A border point goes to the adjoining cluster whose first point is
    earliest.  border_rule 'scan_order' then leaves it noise if it comes before
    that point, as a scan does that has passed it by then; 'standard' does not.

    Points are put into cells whose points are all within ``eps`` of each other.
    A cell of ``min_samples`` points or more has core points only, so neighbours
    are counted for the points of thin cells alone, and no more of them are met
    than a few a cell.  The core points of a cell are one node; whether any two
    core points of two cells are near is found from the boxes of ever smaller
    sub-cells (``_links``), and not from all pairs of points.  A place that is not
    finite is noise.
    """
    scratch = Scratch(points.sparkSession)
    side = eps / 2**0.5 * (1 - 1e-12)
    placed = points.where(finite(("x", "y"))).select("idx", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    sizes = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    cells = scratch.save(placed.join(sizes, ["cx", "cy"]))
    thin = cells.where(F.col("n") < min_samples)
    dense = cells.where(F.col("n") >= min_samples).select("idx")
    counted = _near(thin, cells, eps).groupBy("src").agg(F.count("*").alias("m")).where(F.col("m") >= min_samples).select(F.col("src").alias("idx"))
    cores = scratch.save(cells.join(dense.union(counted), "idx", "left_semi"))
    nodes = scratch.save(cores.groupBy("cx", "cy").agg(F.min("idx").alias("node")))
    own = scratch.save(cores.join(nodes, ["cx", "cy"]).select("idx", "x", "y", "cx", "cy", "node"))
    parts = components(scratch, _links(scratch, own, nodes, eps, side))
    seeded = scratch.save(own.join(parts, "node", "left").select("idx", "x", "y", "cx", "cy", F.coalesce("component", "node").alias("seed")))
    rest = cells.join(seeded.select("idx"), "idx", "left_anti")
    near = _near(rest, seeded, eps, keep=("seed",), query_keep=()).groupBy(F.col("src").alias("idx")).agg(F.min("p_seed").alias("seed"))
    late = F.col("idx") > F.col("seed") if border_rule == "scan_order" else F.col("seed").isNotNull()
    members = scratch.save(seeded.select("idx", "seed").union(near.where(late)))
    seeds = numbered(scratch, scratch.save(members.select("seed").distinct()), ["seed"], "place").select("seed", F.col("place").cast("int").alias("cluster"))
    seeds, seen = scratch.save_counted(seeds, n=F.count("*"))
    scratch.keep_only(members, seeds)
    out = points.select("idx").join(members, "idx", "left")
    return out.join(F.broadcast(seeds) if seen["n"] <= 100_000 else seeds, "seed", "left").select("idx", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


SPLIT, FEW = 4, 1024  # sub-cells on an axis of the cell above; pairs of points that are looked at one by one


def _links(scratch: Scratch, own: DataFrame, nodes: DataFrame, eps: float, side: float) -> DataFrame:
    """``a, b``: the nodes of cells of which two core points are within ``eps``.

    A pair of sub-cells is settled by the boxes of their points: linked if all
    their points are near, out if none can be, and looked at point by point if
    these are ``FEW`` pairs.  The others are split, unless the pair of their cells
    is linked by then.  Boxes shrink to single spots, so this ends.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _STEPS if (a, b) != (0, 0)])).alias("s")
    q = nodes.select(F.col("node").alias("a"), "cx", "cy", steps).select("a", (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"))
    pairs = q.join(nodes.withColumnRenamed("node", "b"), ["cx", "cy"]).where("b < a").select("a", "b", *[F.lit(0).cast("long").alias(f"{n}{c}") for n in "ab" for c in "xy"])
    near, limit, level, linked = pairs, eps * eps, 0, None
    within = (F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")) + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y")) <= limit
    while True:
        def sub(n: int, f: str) -> list[Column]:
            return [(F.floor(F.col(c) / (side / SPLIT**n)) if n else F.lit(0).cast("long")).alias(f"{f}{c}") for c in "xy"]

        active = own if not level else own.join(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "node", "left_semi")
        left = active.select("node", "x", "y", *sub(level, "s"), *sub(level + 1, "t"))
        boxes = left.groupBy("node", "sx", "sy").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))])
        of = lambda t: boxes.select(*[F.col(c).alias({"node": t, "sx": f"{t}x", "sy": f"{t}y"}.get(c, f"{t}_{c}")) for c in boxes.columns])
        met = near.join(of("a"), ["a", "ax", "ay"]).join(of("b"), ["b", "bx", "by"])
        gap = [F.greatest(F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.lit(0.0)) for c in "xy"]
        span = [F.greatest(F.col(f"a_{c}1") - F.col(f"b_{c}0"), F.col(f"b_{c}1") - F.col(f"a_{c}0")) for c in "xy"]
        met = met.select("a", "b", "ax", "ay", "bx", "by", (F.col("a_n") * F.col("b_n") <= FEW).alias("few"), (span[0] * span[0] + span[1] * span[1] <= limit).alias("all"), (gap[0] * gap[0] + gap[1] * gap[1] <= limit).alias("some"))
        met, seen = scratch.save_counted(met.where("some"), n=F.count_if(F.expr("not few and not all")))
        points = lambda t: left.select(F.col("node").alias(t), F.col("sx").alias(f"{t}x"), F.col("sy").alias(f"{t}y"), "x", "y")
        few = met.where("few and not all")
        shown = few.join(points("a").alias("a"), ["a", "ax", "ay"]).join(points("b").alias("b"), ["b", "bx", "by"]).where(within).select("a", "b")
        found = met.where("all").select("a", "b").union(shown).distinct()
        found = scratch.save(found) if seen["n"] else found
        linked = found if linked is None else linked.union(found)
        if not seen["n"]:
            return linked
        # by their own sub-cells; a level has no more pairs than a cell's sub-cells have neighbours
        children = lambda t: left.select(F.col("node").alias(t), F.col("sx").alias(f"{t}x"), F.col("sy").alias(f"{t}y"), F.col("tx").alias(f"{t}u"), F.col("ty").alias(f"{t}v")).distinct()
        rest = met.where("not few and not all").join(found, ["a", "b"], "left_anti")
        near = scratch.save(
            rest.join(children("a"), ["a", "ax", "ay"]).join(children("b"), ["b", "bx", "by"]).select("a", "b", *[F.col(f"{t}{o}").alias(f"{t}{c}") for t in "ab" for c, o in (("x", "u"), ("y", "v"))]))
        level += 1


_STEPS = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4]  # a cell is eps / sqrt 2 wide; of the outermost corners no point is near enough


def _near(queries: DataFrame, points: DataFrame, eps: float, keep: tuple[str, ...] = (), query_keep: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs ``src, dst`` within ``eps`` of points in cells ``cx, cy``, with columns ``q_...`` and ``p_...`` of both."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _STEPS])).alias("s")
    query_keep = keep if query_keep is None else query_keep
    q = queries.select("idx", "x", "y", "cx", "cy", *query_keep, step).select(F.col("idx").alias("src"), "x", "y", *query_keep, (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"))
    p = points.select(F.col("idx").alias("dst"), "x", "y", "cx", "cy", *keep)
    dx, dy = (F.col(f"q.{c}") - F.col(f"p.{c}") for c in "xy")
    on = (F.col("q.cx") == F.col("p.cx")) & (F.col("q.cy") == F.col("p.cy")) & (dx * dx + dy * dy <= eps * eps)
    return q.alias("q").join(p.alias("p"), on).select("src", "dst", *[F.col(f"q.{c}").alias(f"q_{c}") for c in query_keep], *[F.col(f"p.{c}").alias(f"p_{c}") for c in keep])


def targets(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row for each cluster: points, box, height and the area of the box."""
    members = points.join(clusters.where("cluster >= 0"), "idx")
    made = members.groupBy("cluster").agg(F.count("*").alias("points"), *[f(a).alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return made.select(
        F.col("cluster").alias("cluster_id"), "points", "xmin", "ymin", "xmax", "ymax", F.greatest(F.col("zmax") - F.col("zmin"), F.lit(0.0)).alias("height"), "zmin", "zmax",
        ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("area"),
    )
