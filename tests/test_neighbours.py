"""Nearest neighbours against all pairs: any query, any crowd, odd places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import learn, neighbours


def frame(spark, xyz, first=0, part=None):
    rows = [(first + i, *[None if v is None else float(v) for v in r], int(part[i]) if part is not None else 0) for i, r in enumerate(xyz)]
    return spark.createDataFrame(rows, "idx long, x double, y double, z double, part int")


def plain(queries, points, k, axes=3, parts=None):
    """Places of the k nearest by distance and number; rows that are not finite are left out."""
    good = lambda r: all(v is not None and math.isfinite(v) for v in r[:axes])
    out = {}
    for i, q in enumerate(queries):
        if good(q):
            near = sorted((sum((np.float64(q[c]) - np.float64(p[c])) ** 2 for c in range(axes)), j) for j, p in enumerate(points) if good(p) and (parts is None or parts[0][i] == parts[1][j]))
            out |= {(i, r + 1): j for r, (_, j) in enumerate(near[:k])}
    return out


def found(df):
    rows = df.collect()
    out = {(r["src"], r["rank"]): r["dst"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_queries_off_the_box(spark):
    """Few points in a small box and queries far around it, in two axes and three."""
    rng = np.random.default_rng(5)
    points, queries = rng.uniform(-0.5, 0.5, (60, 3)), np.vstack([rng.uniform(-30, 30, (150, 3)), [[1e6, 0, 0], [0, -1e9, 3]]])
    for axes in (("x", "y"), ("x", "y", "z")):
        got = found(neighbours.knn(frame(spark, queries), frame(spark, points), 4, axes))
        assert got == plain(queries, points, 4, len(axes))
    near = {r["idx"]: r["nearest"] for r in neighbours.nearest(frame(spark, queries), frame(spark, points), ["part"]).collect()}
    assert near == {i: j for (i, _), j in plain(queries, points, 1).items()}


def test_null_nan_and_infinite_places(spark):
    rng = np.random.default_rng(6)
    odd = [(None, 0.0, 0.0), (0.0, float("nan"), 0.0), (float("inf"), 0.0, 0.0), (0.0, 0.0, float("-inf"))]
    rows = [tuple(r) for r in rng.uniform(0, 1, (50, 3))] + odd
    assert found(neighbours.knn(frame(spark, rows), frame(spark, rows), 5)) == plain(rows, rows, 5)
    assert neighbours.knn(frame(spark, odd), frame(spark, rows), 5).collect() == []
    with pytest.raises(ValueError):
        neighbours.knn(frame(spark, rows), frame(spark, odd), 5)


def test_crowds_and_strangers(spark):
    """A third of all points in one spot (more than many leaves hold), a close crowd, a line, strangers; fewer points than k in a part."""
    rng = np.random.default_rng(7)
    points = np.vstack([np.repeat([[0.25, 0.5, 0.5]], 250, 0), rng.normal(0, 1e-5, (150, 3)), np.c_[np.linspace(0, 1, 100), np.zeros((100, 2))], rng.uniform(-50, 50, (150, 3)), [[1e4, 0, 0], [-1e5, 2, 2]]])
    points = points[rng.permutation(len(points))]
    p = frame(spark, points)
    assert found(neighbours.knn(p, p, 6)) == plain(points, points, 6)
    queries, parts = rng.uniform(-80, 80, (60, 3)), (rng.integers(0, 4, 60), np.where(np.arange(len(points)) < 3, 3, rng.integers(0, 3, len(points))))
    got = found(neighbours.knn(frame(spark, queries, part=parts[0]), frame(spark, points, part=parts[1]), 5, within=("part",)))
    assert got == plain(queries, points, 5, parts=parts)


def test_repeated_queries_and_all_points(spark):
    points = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]])
    q = frame(spark, [[0.1, 0, 0]]).union(frame(spark, [[0.9, 0, 0]]))  # one number, two queries
    assert sorted((r["src"], r["rank"], r["dst"]) for r in neighbours.knn(q, frame(spark, points), 9).collect()) == [(0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 2, 1), (0, 3, 2), (0, 3, 2)]


def test_many_levels(spark, monkeypatch):
    """Small leaves and nodes, so that the tree has several levels."""
    monkeypatch.setattr(neighbours, "PER_LEAF", 4)
    monkeypatch.setattr(neighbours, "FAN", 2)
    monkeypatch.setattr(neighbours, "PER_BLOCK", 5)
    rng = np.random.default_rng(8)
    points, queries = np.vstack([rng.uniform(0, 9, (300, 3)), rng.integers(0, 3, (100, 3))]), rng.uniform(-5, 15, (80, 3))
    assert found(neighbours.knn(frame(spark, queries), frame(spark, points), 2)) == plain(queries, points, 2)


def test_nearest_cell(spark):
    good = spark.createDataFrame([(0, 0, 1.0), (4, 0, 2.0), (0, 4, 3.0), (900, 900, 9.0)], "ix long, iy long, ground double")
    holes = spark.createDataFrame([(2, 0), (2, 2), (-500, 0), (5000, 5000)], "ix long, iy long")
    got = {(r["ix"], r["iy"]): r["ground"] for r in neighbours.nearest_cell(holes, good).collect()}
    assert got == {(2, 0): 1.0, (2, 2): 1.0, (-500, 0): 1.0, (5000, 5000): 9.0}
    assert neighbours.nearest_cell(holes.where("false"), good).collect() == []
    assert [r["ground"] for r in neighbours.nearest_cell(holes, good.where("false")).collect()] == [None] * 4
    assert neighbours.nearest_cell(holes, good).select(F.count("*")).first()[0] == 4


@pytest.mark.parametrize("few, axes", [(4096, 2), (8, 2), (8, 3)])
def test_radius_counts(spark, monkeypatch, few, axes):
    """A crowd, copies, a lattice at the very radius, strangers and odd places: the counts of all pairs."""
    monkeypatch.setattr(neighbours, "FEW", few)
    rng = np.random.default_rng(9)
    xyz = np.vstack([rng.normal(0, 0.2, (200, 3)), np.repeat([[3.0, 3.0, 0.0]], 60, 0), [[i, j, 0] for i in range(5) for j in range(5)], rng.uniform(-20, 20, (60, 3))])
    near = (((xyz[:, None, :axes] - xyz[None, :, :axes]) ** 2).sum(-1) <= 1.0).sum(1)
    odd = [(None, 0.0, 0.0), (float("nan"), 0.0, 0.0)]
    got = {r["idx"]: r["degree"] for r in neighbours.radius_counts(frame(spark, [tuple(r) for r in xyz] + odd), 1.0, ("x", "y", "z")[:axes]).collect()}
    assert got == dict(enumerate(near.tolist()))


def test_tasks_grow_in_number_with_the_pairs(spark, monkeypatch):
    """A join of few bytes that makes many pairs is dealt over as many tasks as the pairs need, however few partitions a shuffle has."""
    monkeypatch.setattr(neighbours, "PER_TASK", 2000, raising=False)
    cloud = spark.range(3000).select(F.col("id").alias("idx"), *[F.rand(i).alias(c) for i, c in enumerate("xyz")]).cache()
    sc = spark.sparkContext
    sc.setJobGroup("pairs", "")
    try:
        assert neighbours.knn(cloud, cloud, 4).collect()[0]["rank"] >= 1
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    infos = [status.getStageInfo(s) for j in status.getJobIdsForGroup("pairs") for s in status.getJobInfo(j).stageIds]
    assert max(i.numTasks for i in infos if i) >= 3000 * 16 // 2000


DEALT = {
    "multi_scale_max": (lambda p: neighbours.multi_scale_max(neighbours.knn(p, p, 16), p, ["r"], (4, 16)), 1),
    "local_geometry": (lambda p: neighbours.local_geometry(neighbours.knn(p, p, 4), p), 4),
    "nearest_other_label": (lambda p: neighbours.knn(p, p, 2, keep=["label"]).where("src <> dst"), 1),
    "features of a model": (lambda p: learn.features(p), 1),
}


@pytest.mark.parametrize("name", DEALT)
def test_no_task_holds_the_pairs_of_the_whole_table(spark, monkeypatch, name):
    """What is built on neighbours is dealt by the pairs that it makes, and keeps all of its rows."""
    monkeypatch.setattr(neighbours, "PER_TASK", 2000, raising=False)
    cloud = spark.range(1000).select(F.col("id").alias("idx"), *[F.rand(i).alias(c) for i, c in enumerate("xyzrgb")], F.lit(0).alias("label")).cache()
    sc = spark.sparkContext
    sc.setJobGroup(name, "")
    try:
        assert DEALT[name][0](cloud).agg(F.count("*")).first()[0] == DEALT[name][1] * 1000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    infos = [status.getStageInfo(s) for j in status.getJobIdsForGroup(name) for s in status.getJobInfo(j).stageIds]
    assert max(i.numTasks for i in infos if i) >= 1000 * 16 // 2000
