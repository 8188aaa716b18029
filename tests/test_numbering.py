import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import points, quantiles
from skyquilt.operators.numbering import numbered
from skyquilt.storage import Scratch


def test_numbered(spark):
    """Positions are those of a sort, nulls first, and a value that half of the rows have fills several ranges."""
    rng = random.Random(4)
    values = [None if rng.random() < 0.1 else 7 if rng.random() < 0.5 else rng.randint(-50, 50) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, w int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = numbered(Scratch(spark), df, [F.col("v").asc_nulls_first()]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [r["v"] for r in sorted(rows, key=lambda r: r["at"])]
    assert sorted(r["at"] for r in rows) == list(range(3000)) and got == sorted(values, key=lambda v: (v is not None, v or 0))
    assert numbered(Scratch(spark), df.where("false"), ["v"]).count() == 0


@pytest.mark.parametrize("few", [50_000, 5])
def test_quantiles(spark, monkeypatch, few):
    """Values over many magnitudes, one that a third of the rows have, extremes, nulls; the sorted list's quantiles."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(2)
    a = np.r_[rng.normal(0, 1, 300), np.full(200, 3.25), 10.0 ** rng.uniform(-30, 300, 30), [-1.7e308, 1.7e308]]
    b = rng.permutation(len(a)).astype(float)
    rows = [(float(x), float(y), None) for x, y in zip(a, b, strict=True)] + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    qs = [0.0, 0.01, 0.25, 0.5, 0.503, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b", "c"], qs)
    for c, values in (("a", np.sort(a)), ("b", np.sort(b))):
        at = [q * (len(values) - 1) for q in qs]
        assert got[c] == pytest.approx([values[int(p)] * (1 - p % 1) + values[min(int(p) + 1, len(values) - 1)] * (p % 1) for p in at], rel=1e-12)
    assert got["c"] == [None] * len(qs)


def test_draws_do_not_follow_partitions(spark):
    df = spark.createDataFrame([(i, i % 3, float(i), 0.0, 1.0, 0.5, 0.5, 0.5) for i in range(200)], "idx long, scene int, x double, y double, z double, r double, g double, b double")
    one, many = ({r["idx"]: r for r in points.augment(d, 5).collect()} for d in (df.coalesce(1), df.repartition(7, "y", "idx")))
    assert one == many and len({r["r"] for r in one.values()}) > 150
    flat = np.array([(r["z"], r["r"]) for r in points.augment(df, 6).where("scene = 0").collect()])
    assert np.std(flat[:, 1]) == pytest.approx(0.01, rel=0.3) and abs(flat[:, 1].mean() - 0.5) < 0.005


def test_block_split_is_the_shuffle(spark):
    blocked = spark.createDataFrame([(i % 5, i // 5) for i in range(40)] * 2, "bx long, by long")
    rows = sorted(points.split_blocks(blocked, seed=3).collect(), key=lambda r: r["file"])
    order = sorted({(i % 5, i // 5) for i in range(40)})
    assert [(r["bx"], r["by"]) for r in rows] == [order[j] for j in np.random.default_rng(3).permutation(40)]
    assert [r["split"] for r in rows] == ["val"] * 6 + ["test"] * 6 + ["train"] * 28


def test_sample_with_replacement(spark):
    df = spark.createDataFrame([(i * 3, i) for i in range(20)], "idx long, v long")
    rows = points.sample_to(df, 300, 4).collect()
    assert len(rows) == 300 and {r["idx"] for r in rows} == {i * 3 for i in range(20)} and all(r["idx"] == 3 * r["v"] for r in rows)
