"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.storage import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of an undirected graph.

    edges: columns ``a`` and ``b`` (long), in either direction, repeats and loops
    allowed.  Returns ``node, component`` for every node that has an edge to
    another one.  Alternates the large-star and small-star steps of Kiveris et
    al. (2014) until the edges form stars.  Each step needs the minimum of a
    node's neighbours (an aggregate with map-side combine) and one join back, in
    which only the side of the edges can be skewed, which adaptive execution
    splits; no step gathers a node's neighbours in one place.
    """

    def to_smaller(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    mark = {"n": F.count("*"), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, seen = scratch.save_counted(to_smaller(edges), **mark)
    before = None
    while seen != before and seen["n"]:
        before = seen
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour of a node goes to the smallest of the neighbourhood
        large = to_smaller(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small, seen = scratch.save_counted(to_smaller(small), **mark)
        scratch.drop(now)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
