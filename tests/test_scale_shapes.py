"""Shapes that once took a round for each step or met all pairs, against plain versions."""

import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import cluster, compare, screening
from skyquilt.storage import Scratch


def greedy(kept, cover):
    """One image after the other, as the repair is defined."""
    covered = {c for i, c in cover if kept[i]}
    of = {}
    for i, c in cover:
        if not kept[i] and c not in covered:
            of.setdefault(i, set()).add(c)
    out = set()
    while of:
        best = min(of, key=lambda i: (-len(of[i]), i))
        out.add(best)
        gone = of[best]
        of = {i: some - gone for i, some in of.items() if some - gone}
    return out


def repaired(spark, kept, cover):
    k = spark.createDataFrame(list(kept.items()), "idx long, keep boolean")
    c = spark.createDataFrame([(i, *c) for i, c in cover], "idx long, ix long, iy long")
    return {r["idx"] for r in screening.repair_gaps(k, c).where("added").collect()}


@pytest.mark.parametrize("pairs_per_block, seed", [(2_000_000, 1), (40, 2), (12, 3)])
def test_repair_equals_the_sequential_choice(spark, monkeypatch, pairs_per_block, seed):
    monkeypatch.setattr(screening, "PAIRS_PER_BLOCK", pairs_per_block)
    rng = random.Random(seed)
    boxes = {i: (rng.randint(0, 14), rng.randint(0, 5), rng.randint(1, 4), rng.randint(1, 3)) for i in range(60)}
    cover = [(i, (x + a, y + b)) for i, (x, y, w, h) in boxes.items() for a in range(w) for b in range(h)]
    kept = {i: rng.random() < 0.1 for i in boxes}
    assert repaired(spark, kept, cover) == greedy(kept, cover)


def test_repair_of_a_long_chain(spark, monkeypatch):
    """Each image decides about the next: 400 in blocks of 100, in rounds by block and not by image."""
    sizes, start, cover = [3000 - i for i in range(400)], 0, []
    monkeypatch.setattr(screening, "PAIRS_PER_BLOCK", 2500)
    for i, n in enumerate(np.repeat(range(40, 0, -1), 10)):
        cover += [(i, (start + c, 0)) for c in range(int(n) // 2 + 4)]
        start += int(n) // 4 + 1
    tables, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **b: tables.append(1) or save(self, *a, **b))
    kept = dict.fromkeys(range(len(sizes)), False)
    assert repaired(spark, kept, cover) == greedy(kept, cover) and len(tables) < 30


def test_repair_of_2000_images(spark, monkeypatch):
    """A flight line of falling gains in one block: a few tables, the sequential choice."""
    cover = [(i, (i * 20 + c, 0)) for i in range(2000) for c in range(60 - i % 30)]
    tables, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **b: tables.append(1) or save(self, *a, **b))
    kept = dict.fromkeys(range(2000), False)
    assert repaired(spark, kept, cover) == greedy(kept, cover) and len(tables) <= 10


@pytest.mark.parametrize("few", [1024, 1])
def test_links_equal_all_pairs(spark, monkeypatch, few):
    """Cells linked by their closest points only, at the limit and just beyond, with copies."""
    monkeypatch.setattr(cluster, "FEW", few)
    rng = np.random.default_rng(3)
    eps, side = 1.0, 1 / 2**0.5 * (1 - 1e-12)
    xy = np.vstack([rng.uniform(0, 6, (300, 2)), np.round(rng.uniform(0, 6, (60, 2)), 1), np.repeat([[9.0, 9.0]], 30, 0), [[10.0, 9.0], [9.0, 7.9999]], np.repeat([[20.0, 0.0], [21.0000001, 0.0]], 40, 0)])
    rows = [(i, float(x), float(y), int(x // side), int(y // side)) for i, (x, y) in enumerate(xy)]
    node = {}
    for i, _, _, cx, cy in rows:
        node.setdefault((cx, cy), i)
    own = spark.createDataFrame([(*r, node[r[3], r[4]]) for r in rows], "idx long, x double, y double, cx long, cy long, node long")
    nodes = spark.createDataFrame([(*c, n) for c, n in node.items()], "cx long, cy long, node long")
    scratch = Scratch(spark)
    got = {(r["a"], r["b"]) for r in cluster._links(scratch, scratch.save(own), nodes, eps, side).collect()}
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= eps * eps
    of = [node[r[3], r[4]] for r in rows]
    assert got == {(of[i], of[j]) for i, j in zip(*np.nonzero(near), strict=True) if of[j] < of[i]}


def test_two_crowded_cells(spark):
    """300,000 points in two cells: one cluster, without their 22 thousand million pairs."""
    p = spark.range(300_000).select(F.col("id").alias("idx"), (F.rand(1) * 0.7 + F.when(F.col("id") % 2 == 0, 0.0).otherwise(0.7072)).alias("x"), (F.rand(2) * 0.7).alias("y"))
    began = time.time()
    rows = cluster.dbscan(Scratch(spark).save(p), 1.0, 20).groupBy("cluster").count().collect()
    assert [(r["cluster"], r["count"]) for r in rows] == [(0, 300_000)] and time.time() - began < 120


def test_boxes_of_many_copies(spark):
    """30,000 copies on either side are one pair of boxes, not 900 million; all get their row and the smallest id."""
    boxes = lambda first, side: spark.range(first, first + 30_000).select("id", *[F.lit(v).alias(c) for c, v in (("xmin", 0.0), ("ymin", 0.0), ("xmax", side), ("ymax", side))])
    began = time.time()
    got = compare.best_boxes(boxes(0, 2.0), boxes(100, 4.0), 10.0).groupBy("ref_id", "iou").agg(F.count("*"), F.count_distinct("id")).collect()
    assert [tuple(r) for r in got] == [(100, 0.25, 30_000, 30_000)] and time.time() - began < 30


def test_a_block_is_chosen_from_in_little_memory():
    """200,000 pairs with rivals at every cell: arrays and no sets or tuples for each."""
    n = 200_000
    at = np.arange(n)
    pairs = pd.DataFrame({"idx": at // 25, "ix": at // 25 % 90 + at % 5, "iy": at // 2250 + at // 5 % 5, "rival_gain": 1.0, "rival_minus": -1.0})
    tracemalloc.start()
    try:
        assert len(screening._taken(pairs))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * n
