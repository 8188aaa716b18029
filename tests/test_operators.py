import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.config import Camera
from skyquilt.functions import geometry as G
from skyquilt.operators import cluster, compare, metrics, neighbours, points, screening
from skyquilt.operators.graph import components
from skyquilt.storage import Scratch

POSE = "idx long, x double, y double, z double, omega double, phi double, kappa double"


def test_footprint(spark):
    pos = spark.createDataFrame([(0, 0.0, 0.0, 120.0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 120.0, 0.0, 25.0, 90.0), (2, 0.0, 0.0, 120.0, 0.0, 75.0, 0.0)], POSE)
    got = {r["idx"]: r for r in screening.footprints(pos, Camera()).collect()}
    assert sorted(got) == [0, 1]
    flat = [(p["x"], p["y"]) for p in got[0]["polygon"]]
    assert flat == [pytest.approx(v, abs=1e-5) for v in ((-61.714286, 41.142857), (61.714286, 41.142857), (61.714286, -41.142857), (-61.714286, -41.142857))]
    assert got[0]["area"] == pytest.approx(10156.4082, abs=1e-3) and got[1]["area"] == pytest.approx(14368.233, abs=1e-3)
    assert [(p["x"], p["y"]) for p in got[1]["polygon"]][0] == pytest.approx((115.578035, 81.052623), abs=1e-5)


def test_grid():
    g = screening.make_grid(0, 0, 40, 40, 20)
    assert (g.x0, g.nx, g.ny) == (10, 2, 2)
    for box in ((0, 0, 0, 40, 20), (0, 0, 40, 40, 100)):
        with pytest.raises(ValueError):
            screening.make_grid(*box)


def test_point_in_polygon(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    pts = spark.createDataFrame([(1.0, 1.0, True), (2.0, 1.0, True), (0.0, 0.0, True), (2.0, 2.0, True), (2.1, 1.0, False)], "x double, y double, want boolean")
    assert all(r[0] == r[1] for r in pts.select(G.in_polygon(F.col("x"), F.col("y"), square), "want").collect())


def test_scores_and_repair(spark):
    cover = spark.createDataFrame([(i, c, 0) for i, cells in enumerate([[1, 2, 3], [2, 3], [4], [1, 2, 3]]) for c in cells], "idx long, ix long, iy long")
    scores = screening.contribution(spark.range(4).withColumnRenamed("id", "idx"), cover, 4)
    got = {r["idx"]: r["score"] for r in scores.collect()}
    assert got == {0: 0.75, 1: 0.25, 2: 0.25, 3: 0.375}
    kept = screening.repair_gaps(screening.select_images(scores, 0.3), cover).collect()
    assert {r["idx"] for r in kept if r["keep"]} == {0, 2, 3}
    none = screening.repair_gaps(screening.select_images(scores, 9.0), cover).collect()
    assert {r["idx"] for r in none if r["keep"]} == {0, 2}


def test_owners_equal_a_scan(spark):
    rng = random.Random(3)
    rel = {i: {c for c in range(20) if rng.random() < 0.3} for i in range(12)}
    order, seen, new = sorted(rel, key=lambda i: (-len(rel[i]), i)), set(), {}
    for i in order:
        new[i] = len(rel[i] - seen) / 20
        seen |= rel[i]
    cover = spark.createDataFrame([(i, c, 0) for i in rel for c in rel[i]], "idx long, ix long, iy long")
    got = screening.contribution(spark.range(12).withColumnRenamed("id", "idx"), cover, 20).collect()
    assert {r["idx"]: r["new_ratio"] for r in got} == pytest.approx(new)


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r[:3]), 0.5, 0.5, 0.5, r[3] if len(r) > 3 else 0) for i, r in enumerate(rows)], "idx long, x double, y double, z double, r double, g double, b double, label int")


def test_voxels(spark):
    p = cloud(spark, [(0.1, 0, 0, 2), (0.2, 0, 0, 1), (0.3, 0, 0, 2), (0.4, 0, 0, 1), (-0.5, 0, 0, 5)])
    got = {r["kx"]: (r["n"], r["label"]) for r in points.voxel_mean(p, 1.0).collect()}
    assert got == {0: (4, 1), -1: (1, 5)}
    assert {r["idx"] for r in points.voxel_first(p, 1.0).collect()} == {0}


def test_shapes(spark):
    flat, wall = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1)]
    for rows, want in ((flat, (1, 0, 0)), (wall, (1, 0, 1)), ([(0, 0, 0)], (0, 0, 1))):
        r = points.voxel_shape(points.voxel_moments(cloud(spark, rows), 5.0)).first()
        assert (r["planarity"], r["roughness"], r["verticality"]) == pytest.approx(want, abs=1e-9)


def test_shapes_equal_a_solver(spark):
    """Clouds of every rank and proportion: eigenvalues and normals of a library's solver; equal smallest ones by the most vertical vector."""
    rng = np.random.default_rng(1)
    clouds = [rng.normal(0, 1, (n, 3)) @ np.diag(rng.choice([0, 1e-7, 1e-3, 1, 1, 30], 3)) @ np.linalg.qr(rng.normal(0, 1, (3, 3)))[0] for n in rng.integers(1, 9, 300)]
    moments = [(i, *(np.cov(c.T, bias=True)[a, b].item() for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for i, c in enumerate(clouds)]
    moments += [(1000, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0), (1001, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0), (1002, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0), (1003, 2.0, 0.0, 0.0, 2.0, 0.0, 1.0), (1004, 2.0, 0.0, 0.0, 1.0, 0.0, 1.0)]
    for r in points.voxel_shape(spark.createDataFrame(moments, "i long, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")).collect():
        m = np.array([[r["cxx"], r["cxy"], r["cxz"]], [r["cxy"], r["cyy"], r["cyz"]], [r["cxz"], r["cyz"], r["czz"]]])
        e, v = np.linalg.eigh(m)
        top = max(e[2], 1e-300)
        same = (e - e[0]) <= 1e-9 * top
        up = 0.0 if same.all() or e[2] <= 0 else math.sqrt((v[2, same] ** 2).sum())
        assert r["planarity"] == pytest.approx((e[1] - e[0]) / max(e[2], 1e-12), abs=1e-9), r
        assert r["roughness"] ** 2 == pytest.approx(max(e[0], 0), abs=1e-12 * top)
        near_tie = not same.all() and 1e-12 < (e[1] - e[0]) / top < 1e-5  # the normal itself is ill-conditioned
        assert near_tie or r["verticality"] == pytest.approx(1 - up, abs=1e-6), (r, e)


def test_ground(spark):
    p = cloud(spark, [(0.5, 0.5, z) for z in range(5)] + [(1.5, 0.5, 9)] * 4)
    got = points.height_above_ground(p).collect()
    assert len(got) == 9 and {round(r["ground"], 9) for r in got} == {0.2}


def test_metrics(spark):
    c = metrics.confusion(spark.createDataFrame(list(zip([0, 0, 1, 1], [0, 1, 1, 2], strict=True)), "label int, pred int"), 3)
    r = metrics.overall(c, 3).first()
    assert (r["oa"], r["macc"], r["miou"]) == pytest.approx((0.5, 0.5, (1 / 2 + 1 / 3 + 0) / 3))


def test_dbscan_border(spark):
    line = lambda xs: cloud(spark, [(x, 0, 0) for x in xs])
    labels = lambda p, **k: [r["cluster"] for r in cluster.dbscan(p, 1.0, 3, **k).orderBy("idx").collect()]
    assert labels(line([0, 1.0, 1.5, 2.0])) == [-1, 0, 0, 0]
    assert labels(line([0, 1.0, 1.5, 2.0]), border_rule="standard") == [0, 0, 0, 0]
    assert labels(line([1.0, 1.5, 2.0, 0])) == [0, 0, 0, 0]


def plain_dbscan(xy, eps, least):
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= eps * eps
    core, label, seeds = near.sum(1) >= least, np.full(len(xy), -1), []
    for i in range(len(xy)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = len(seeds)
                    todo += [int(m) for m in np.flatnonzero(near[j] & core) if label[m] < 0]
            seeds.append(i)
    for i in np.flatnonzero(~core):
        some = [label[m] for m in np.flatnonzero(near[i] & core)]
        if some and i > seeds[min(some)]:
            label[i] = min(some)
    return label.tolist()


def test_dbscan_equals_a_scan(spark):
    """A third of all points in one cell, copies of one point, and thin parts."""
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.normal(0, 0.1, (120, 2)), rng.uniform(-12, 12, (200, 2)), np.repeat([[3.0, 3.0]], 30, 0), rng.normal(5, 1, (60, 2))])
    xy = xy[rng.permutation(len(xy))]
    got = [r["cluster"] for r in cluster.dbscan(cloud(spark, [(x, y, 0) for x, y in xy]), 1.0, 5).orderBy("idx").collect()]
    assert got == plain_dbscan(xy, 1.0, 5) and max(got) > 1


def test_repair_of_one_gap(spark):
    """Nothing is kept, so the whole survey is one gap."""
    rng = random.Random(7)
    rel = {i: {c for c in range(60) if rng.random() < 0.2} for i in range(25)}
    want, left = [], set().union(*rel.values())
    while left:
        best = min(rel, key=lambda i: (-len(rel[i] & left), i))
        want.append(best)
        left -= rel[best]
    cover = spark.createDataFrame([(i, c, 0) for i in rel for c in rel[i]], "idx long, ix long, iy long")
    scores = screening.contribution(spark.range(25).withColumnRenamed("id", "idx"), cover, 60)
    got = screening.repair_gaps(screening.select_images(scores, 9.0), cover).collect()
    assert {r["idx"] for r in got if r["keep"]} == set(want) == {r["idx"] for r in got if r["added"]}
    assert not any(r["added"] for r in screening.repair_gaps(screening.select_images(scores, 0.0), cover).collect())


def test_knn(spark):
    rng = np.random.default_rng(0)
    xyz = np.vstack([rng.normal(size=(60, 3)), [[50.0, 50.0, 50.0]]])
    got = {(r["src"], r["rank"]): r["dst"] for r in neighbours.knn(cloud(spark, xyz.tolist()), cloud(spark, xyz.tolist()), 4).collect()}
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    assert got == {(i, k + 1): j for i in range(61) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}


def test_knn_in_a_crowd(spark):
    """A third of all points in one place or close by, copies of one point, and far strangers."""
    rng = np.random.default_rng(2)
    xyz = np.vstack([rng.normal(0, 1e-4, (150, 3)), np.repeat([[0.5, 0.5, 0.5]], 60, 0), rng.uniform(-50, 50, (250, 3)), [[900.0, 0.0, 0.0]]])
    xyz = xyz[rng.permutation(len(xyz))]
    p = cloud(spark, xyz.tolist())
    got = {(r["src"], r["rank"]): r["dst"] for r in neighbours.knn(p, p, 6).collect()}
    d = sum((xyz[:, None, c] - xyz[None, :, c]) ** 2 for c in range(3))
    assert got == {(i, k + 1): j for i in range(len(xyz)) for k, j in enumerate(np.argsort(d[i], kind="stable")[:6])}
    parts = p.withColumn("part", F.col("idx") % 2)
    got = {(r["src"], r["rank"]): r["dst"] for r in neighbours.knn(parts, parts, 3, within=("part",)).collect()}
    side = np.arange(len(xyz)) % 2
    apart = np.where(side[:, None] == side[None], d, np.inf)
    assert got == {(i, k + 1): j for i in range(len(xyz)) for k, j in enumerate(np.argsort(apart[i], kind="stable")[:3])}


def test_blocks(spark):
    p = cloud(spark, [(x, y, 0) for x in (0, 50, 100) for y in range(50)])
    got = points.blocks(p, 50.0, 0.0, 10).groupBy("bx", "by").count().collect()
    assert sorted((r["bx"], r["by"], r["count"]) for r in got) == [(0, 0, 50), (1, 0, 50)]


def test_yaw(spark):
    df = spark.createDataFrame([(-10.5, None, 349.5, 349.5), (None, 370.0, 10.0, 10.0), (350.0, 20.0, 350.0, 10.0), (None, None, None, None)], "g double, f double, a double, b double")
    for r in df.select("a", "b", G.yaw(F.col("g"), F.col("f")), G.yaw(F.col("g"), F.col("f"), True)).collect():
        assert r[0] == r[2] and r[1] == r[3]


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 51), (60, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(Scratch(spark), edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}


def test_iou(spark):
    box = "id long, xmin double, ymin double, xmax double, ymax double"
    m = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 50.0, 50.0, 51.0, 51.0)], box)
    r = spark.createDataFrame([(7, 1.0, 0.0, 3.0, 2.0), (8, 0.0, 0.0, 2.0, 1.9)], box)
    got = {x["id"]: (x["ref_id"], x["iou"]) for x in compare.best_boxes(m, r, 10.0).collect()}
    assert got[1] == (8, pytest.approx(0.95)) and got[2] == (None, None)
    assert math.isclose(518.362 / 561.387 * 100 - 100, -7.664063, abs_tol=1e-5)


def test_blocks_at_rounded_edges(spark):
    """Prices whose quotients round below the whole number: the edges alone decide."""
    ys = [c / 100 / 2000 for c in (90001, 4090001, 8090001, 10090001, 15000000)]
    low, high = min(ys), max(ys)
    want = sorted((i, y) for y in ys for i in range(math.ceil((high - low) / 10)) if low + i * 10 <= y < low + i * 10 + 20)
    assert (2, ys[2]) in want and math.floor((ys[2] - low - 20) / 10) == 2
    cloud = spark.createDataFrame([(i, float(x), y) for i, (x, y) in enumerate((x, y) for x in (0, 1) for y in ys)], "idx long, x double, y double")
    got = sorted((r["by"], r["y"]) for r in points.blocks(cloud, 20.0, 0.5, 1).where("x = 0").collect())
    assert got == want


@pytest.mark.parametrize("shares, want", [([0.5, 0.25], math.log(8) / 2), ([0.5, 0.0], math.inf), ([0.5, -0.1], math.nan), ([0.0, math.nan], math.nan), ([0.5, None], math.log(2))])
def test_cross_entropy_of_shares_that_are_not_positive(spark, shares, want):
    rows = spark.createDataFrame([(0, [p, 1.0]) for p in shares], "label int, probs array<double>")
    assert metrics.cross_entropy(rows).first()["loss"] == pytest.approx(want, nan_ok=True)
