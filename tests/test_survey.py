"""Whole runs, and the small parts that no query registers."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.config import Camera, ScreeningConfig
from skyquilt.functions import geometry as G
from skyquilt.operators import compare, learn, metrics, points, screening
from skyquilt.plans.survey import classify_and_extract, screen
from skyquilt.sources import demo_scene, point_files, pos_csv
from skyquilt.streaming import tiles
from test_operators import cloud


def table(spark, tmp_path, header, rows):
    path = tmp_path / f"pos{len(list(tmp_path.iterdir()))}.csv"
    path.write_text("\n".join([header, *rows]) + "\n")
    return pos_csv.read_pos(spark, str(path))


def spots():
    return [(57.3 * i, 41.7 * j) for j in range(2) for i in range(3)]  # no cell centre on an edge


def kept(run):
    return {r["idx"]: (r["covered"], round(r["score"], 9), r["keep"]) for r in run.kept.collect()}


def test_screen_degrees_and_metres_agree(spark, tmp_path):
    lat0 = 31.2
    scale = 111320.0 * math.cos(math.radians(lat0))
    plane = table(spark, tmp_path, "name,x,y,z", [f"a{k},{x},{y},120" for k, (x, y) in enumerate(spots())])
    config = ScreeningConfig(grid_size=20.0, threshold=0.05, ref_lon=120.3, ref_lat=lat0)
    one = screen(plane, config)
    degrees = table(spark, tmp_path, "name,lon,lat,z", [f"a{k},{120.3 + x / scale!r},{lat0 + y / 110540.0!r},120" for k, (x, y) in enumerate(spots())] + ["lost,,,120"])
    two = screen(degrees, config)
    assert kept(one) == kept(two) and len(kept(two)) == 6  # the record without a place is left out
    mean = screen(degrees, replace(config, ref_lon=None, ref_lat=None))
    assert len(kept(mean)) == 6


def test_screen_area_in_degrees(spark, tmp_path):
    pos = table(spark, tmp_path, "name,lon,lat,z", [f"a{k},{120.3 + 0.0005 * k},{31.2 + 0.0002 * k},120" for k in range(5)])
    box = (120.2995, 31.1995, 120.3015, 31.2015)
    grid = screen(pos, ScreeningConfig(area_lonlat=box, allow_gaps=True)).grid
    lon0, lat0 = 120.3 + 0.001, 31.2 + 0.0004  # the mean of the records
    x0, y0 = (box[0] - lon0) * 111320.0 * np.cos(np.radians(lat0)), (box[1] - lat0) * 110540.0
    assert (grid.x0, grid.y0) == (pytest.approx(x0 + 10), pytest.approx(y0 + 10))
    plane = table(spark, tmp_path, "name,x,y,z", ["a,0,0,120"])
    with pytest.raises(ValueError):
        screen(plane, ScreeningConfig(area_lonlat=box))


def test_camera_of_the_records(spark):
    pos = spark.createDataFrame([(0, None, 4000, 3000), (1, 24.0, 6000, 4000)], "idx long, focal_mm double, image_width_px int, image_height_px int")
    assert screening.resolve_camera(pos, None) == Camera(24.0, 36.0, 24.0, 6000, 4000)
    assert screening.resolve_camera(pos, Camera(50.0)).focal_mm == 50.0


def test_files_lists_and_moves(spark, tmp_path):
    pos = spark.createDataFrame([(0, "a"), (1, "b.jpg"), (2, "zz")], "idx long, name string")
    files = spark.createDataFrame([("/d/x/a.JPG",), ("/d/b.jpg",), ("/d/y/a.jpg",)], "path string")
    got = {r["idx"]: r["file"] for r in screening.match_files(pos, files).collect()}
    assert got == {0: "/d/x/a.JPG", 1: "/d/b.jpg", 2: "zz"}
    flags = screening.match_files(pos, files).withColumn("keep", F.col("idx") == 0)
    pos_csv.write_lists(flags, str(tmp_path / "lists"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lists/removed")).collect()] == ["/d/b.jpg", "zz"]
    plan = screening.move_plan(flags, flags.select("idx", F.col("file").alias("path")), "/d", "/gone").collect()
    assert {r["destination"] for r in plan} == {"/gone/b.jpg", "/gone/zz"}


def test_reports(spark, tmp_path):
    scores = spark.createDataFrame([(1, 3, 0.5, 0.25, 0.375, True), (0, 1, 0.1, 0.0, 0.05, False)], "idx long, covered long, base_ratio double, new_ratio double, score double, keep boolean")
    pos_csv.write_report(scores, 6, str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "report"), header=True).collect()] == [("0", "1", "6", "0.100000", "0.000000", "0.050000", "no"), ("1", "3", "6", "0.500000", "0.250000", "0.375000", "yes")]
    targets = spark.createDataFrame([(0, 5, 9.0, 0.0, 12.0, 1.0, 2.0, 0.0, 2.0, 3.0), (1, 4, 1.5, 0.0, 2.0, 1.0, 2.5, 0.0, 2.5, 0.5)], "cluster_id int, points long, xmin double, ymin double, xmax double, ymax double, height double, zmin double, zmax double, area double")
    pos_csv.write_targets(targets, str(tmp_path / "targets"))
    rows = spark.read.csv(str(tmp_path / "targets"), header=True).collect()
    assert [(r["cluster_id"], r["xmin"], r["area"]) for r in rows] == [("1", "1.500", "0.50"), ("0", "9.000", "3.00")]


def test_vertical_view(spark):
    r = spark.range(1).select(*G.vertical_sides(F.lit(70.0), Camera()), G.square_around(F.lit(1.0), F.lit(2.0), F.lit(4.0))).first()
    assert (r[0], r[1]) == (72.0, 48.0) and [(p["x"], p["y"]) for p in r[2]] == [(-1.0, 4.0), (3.0, 4.0), (3.0, 0.0), (-1.0, 0.0)]


def test_scene_parts(spark):
    p = cloud(spark, [(0, 0, 0), (1, 2, 3), (4, 4, 4)])
    bare = p.drop("r", "g", "b")
    joined = points.concat_scenes([p, bare])
    assert joined.count() == 6 and joined.where("r is not null").count() == 0
    assert points.concat_scenes([p, p]).where("r is not null").count() == 6
    assert sorted(r["x"] for r in points.gather(p, spark.createDataFrame([(1,), (1,), (2,)], "idx long")).collect()) == [1.0, 1.0, 4.0]
    assert [len(r["features"]) for r in points.feature_vector(p, True).collect()] == [6, 6, 6]
    turned = points.augment(p.withColumn("scene", F.lit(1)), 3).agg(F.max("z"), F.max("r"), F.min("r")).first()
    assert 3.3 < turned[0] < 4.6 and turned[1] <= 1.0 and turned[2] >= 0.0
    many = points.sample_to(p, 50, 1)
    assert many.count() == 50 and many.select("idx").distinct().count() == 3


def test_split_folders_and_blocks(spark, tmp_path):
    (tmp_path / "train").mkdir()
    np.save(tmp_path / "train" / "a.npy", np.ones((4, 3)))
    assert point_files.read_split(spark, str(tmp_path), "train").count() == 4
    assert point_files.read_split(spark, str(tmp_path / "train"), "val").count() == 4
    blocked = spark.createDataFrame([("train", 0, 1.0), ("val", 1, 2.0)], "split string, file int, x double")
    point_files.write_blocks(blocked, str(tmp_path / "blocks"))
    assert spark.read.parquet(str(tmp_path / "blocks")).where("split = 'val'").first()["x"] == 2.0


def test_ratio(spark):
    rows = spark.createDataFrame([(1, 4.0), (2, 6.0)], "k int, v double")
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2)], "label int, pred int, n long")
    assert sorted(r["share"] for r in metrics.top_share(counts).collect()) == [0.25, 0.75, 1.0]
    assert [r["ratio"] for r in compare.ratio_to_first(rows, "v", "k").orderBy("k").collect()] == [1.0, 1.5]


def test_demo_scene(spark):
    scene = demo_scene.demo_scene(spark)
    counts = {r["label"]: r["count"] for r in scene.groupBy("label").count().collect()}
    assert counts[4] == 1320 and counts[2] == 1200 and counts[5] == 180 and counts[1] in (1440, 2160, 2880) and counts[3] in range(600, 1051, 150)
    box = scene.agg(F.avg("x"), F.max("x") - F.min("x"), F.min("r"), F.max("r")).first()
    assert abs(box[0]) < 1e-6 and 118 < box[1] < 125 and box[2] >= 30 and box[3] <= 240
    assert scene.select("idx").distinct().count() == scene.count()
    walls = scene.where("label = 1 and abs(g / r - 0.92) < 1e-9").agg(F.min("r"), F.max("r")).first()  # darkest: a wall at the ends, 0.8 of 170 or more
    assert 0.8 * 170 <= walls[0] < 0.8 * 180 and walls[1] <= 220
    built = classify_and_extract(scene.withColumns({c: F.col(c) / 255 for c in "rgb"}), eps=2.0, min_samples=10)
    assert built.count() >= 1


def test_models(spark, tmp_path):
    scene = demo_scene.demo_scene(spark, 1500).withColumns({c: F.col(c) / 255 for c in "rgb"}).where("pmod(idx, 4) = 0").cache()
    model = learn.fit(scene)
    for want in (["000000"], ["000000", "000001"], ["000001", "000002"]):
        assert learn.save_model(model, str(tmp_path / "models"), keep=2) == want
    again = learn.load_model(str(tmp_path / "models"), "000002")
    assert learn.predict(again, scene).join(learn.predict(model, scene).withColumnRenamed("pred", "p"), "idx").where("pred <> p").isEmpty()
    got = learn.evaluate(model, scene, 6).first()
    assert got["judged"] == scene.count() and got["oa"] > 0.7
    assert learn.predict_cloud(model, scene, 2000).count() == 2000
    item = learn.dataset_item(scene, 100, 1.0, seed=1, train=True, k=4)
    assert item.count() == 100 and len(item.first()["features"]) == 6


def test_fit_makes_features_once(spark, monkeypatch):
    """A forest reads its points several times; the search for neighbours behind their features is done once."""
    scene = demo_scene.demo_scene(spark, 1500).withColumns({c: F.col(c) / 255 for c in "rgb"}).where("pmod(idx, 4) = 0").cache()
    made, features = spark.sparkContext.accumulator(0), learn.features

    def counted(points, scales):
        @F.udf("double")
        def seen(v):
            made.add(1)
            return v

        return features(points, scales).withColumn("x", seen("x"))

    monkeypatch.setattr(learn, "features", counted)
    learn.fit(scene, trees=2)
    assert made.value == scene.count()


def test_streams(spark, tmp_path):
    rows = cloud(spark, [(0.2, 0, 1, 2), (0.4, 0, 3, 2), (9, 0, 0, 1)])
    rows.write.parquet(str(tmp_path / "in"))
    streamed = tiles.stream_points(spark, str(tmp_path / "in"), rows.schema)
    for name, df in (("voxels", tiles.voxel_counts(streamed, 1.0)), ("classes", tiles.class_totals(streamed))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r["kx"], r["n"]) for r in spark.table("voxels").collect()} == {(0, 1), (9, 1)} or spark.table("voxels").agg(F.sum("n")).first()[0] == 3
    assert {r["label"]: r["n"] for r in spark.table("classes").collect()} == {2: 2, 1: 1}
