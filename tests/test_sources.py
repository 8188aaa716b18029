import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import compare, points
from skyquilt.sources import image_meta, point_files, pos_csv

XMP = b'<x:xmpmeta><rdf:Description drone-dji:GimbalPitchDegree="-60.00" drone-dji:FlightYawDegree="+370"><drone-dji:RelativeAltitude> 80.5 </drone-dji:RelativeAltitude></rdf:Description></x:xmpmeta>'


def exif():
    def ifd(at, entries):
        body, extra, off = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, count, raw in entries:
            if len(raw) <= 4:
                body += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                body += struct.pack("<HHII", tag, kind, count, off + len(extra))
                extra += raw
        return body + b"\0\0\0\0" + extra

    dms = lambda *v: b"".join(struct.pack("<II", int(x * 1000), 1000) for x in v)
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, dms(31, 30, 0)), (3, 2, 2, b"E\0"), (4, 5, 3, dms(120, 15, 36)), (5, 1, 1, b"\1"), (6, 5, 1, dms(12.5))]
    cam = [(0xA002, 4, 1, struct.pack("<I", 6000)), (0xA003, 4, 1, struct.pack("<I", 4000)), (0x920A, 5, 1, dms(35)), (0xA405, 3, 1, struct.pack("<H", 35))]
    first = lambda e, g: ifd(8, [(0x010F, 2, 4, b"DJI\0"), (0x8769, 4, 1, struct.pack("<I", e)), (0x8825, 4, 1, struct.pack("<I", g))])
    e = 8 + len(first(0, 0))
    g = e + len(ifd(e, cam))
    return b"Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + first(e, g) + ifd(e, cam) + ifd(g, gps)


def test_pos_csv(spark, tmp_path):
    (tmp_path / "pos.csv").write_bytes("\ufeff影像名,Lon (gitude),纬度,Z,yaw,other\na,120.5,31.25,100,90,x\n,,,,,\n,120.6,31.5,,,\n".encode())
    got = pos_csv.read_pos(spark, str(tmp_path / "pos.csv")).orderBy("idx").collect()
    assert [(r["name"], r["lat"], r["z"], r["kappa"], r["phi"]) for r in got] == [("a", 31.25, 100.0, 90.0, 0.0), ("image_000002", 31.5, 0.0, 0.0, 0.0)]
    assert got[0]["lon"] == 120.5
    (tmp_path / "bad.csv").write_text("name,lon\na,x1\n")
    with pytest.raises(Exception):
        pos_csv.read_pos(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "none.csv").write_text("q,w\n1,2\n")
    with pytest.raises(ValueError):
        pos_csv.read_pos(spark, str(tmp_path / "none.csv"))


def test_image_metadata(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + exif() + XMP)
    (tmp_path / "b.JPG").write_bytes(b"\xff\xd8" + XMP)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["file"][-5]: r for r in image_meta.merge_metadata(image_meta.read_headers(files)).collect()}
    a = got["a"]
    assert (a["lat"], a["lon"], a["z"]) == pytest.approx((-31.5, 120.26, -12.5)) and (a["phi"], a["kappa"]) == (30.0, 10.0)
    assert (a["sensor_width_mm"], a["sensor_height_mm"], a["image_width_px"], a["make"]) == (pytest.approx(36.0), pytest.approx(24.0), 6000, "DJI")
    assert got["b"]["z"] == 80.5 and got["b"]["lat"] is None
    assert [r["path"][-5:] for r in pos_csv.list_images(spark, str(tmp_path)).collect()] == ["a.jpg", "b.JPG"]


def test_las(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y), float(z), 65535, 257, 0, int(k)) for x, y, z, k in zip(*rng.uniform(0, 100, (3, 50)).round(3), rng.integers(0, 6, 50), strict=True)]
    df = spark.createDataFrame(rows, "x double, y double, z double, red int, green int, blue int, label short").coalesce(1)
    point_files.write_las(df, str(tmp_path / "out"))
    got = point_files.read_las(spark, str(tmp_path / "out")).orderBy("idx").collect()
    assert [(round(r["x"], 3), round(r["y"], 3), r["red"], r["label"]) for r in got] == [(r[0], r[1], r[3], r[6]) for r in rows]
    assert point_files.read_las(spark, str(tmp_path / "out"), (500.0, 500.0, 600.0, 600.0)).count() == 0
    point_files.write_las(df.limit(7), str(tmp_path / "out"))  # appends
    assert point_files.read_las(spark, str(tmp_path / "out")).count() == 57
    point_files.write_las(df.limit(5), str(tmp_path / "out"), "overwrite", 0.01, (1.0, 2.0, 3.0))
    again = point_files.read_las(spark, str(tmp_path / "out"))
    assert again.count() == 5 and [f for f in os.listdir(tmp_path / "out") if f.startswith(".")] == []
    (tmp_path / "empty").mkdir()
    assert point_files.read_las(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="too far"):
        point_files.write_las(df.withColumn("x", F.col("x") * 1e9), str(tmp_path / "far"))
    assert not [f for f in os.listdir(tmp_path / "far")]
    point_files.write_las(df.limit(0), str(tmp_path / "none"))
    assert point_files.read_las(spark, str(tmp_path / "none")).count() == 0


def test_las_colours(spark, tmp_path):
    df = spark.createDataFrame([("a", 65535, 257, 0), ("b", 255, 10, 0), ("b", None, 20, 1)], "tile string, red int, green int, blue int")
    got = [(r["r"], r["g"], r["b"]) for r in point_files.las_cloud(df).orderBy("tile", "green").collect()]
    assert got == [(255.0, 1.0, 0.0), (255.0, 10.0, 0.0), (0.0, 20.0, 1.0)] or got[:2] == [(255.0, 1.0, 0.0), (255.0, 10.0, 0.0)]
    got = point_files.las_cloud(df, unit=True).where("tile = 'a'").first()
    assert (got["r"], got["g"]) == (1.0, pytest.approx(257 / 65535))
    cls = spark.createDataFrame([(1.0, 0.5, 0.0, 1), (1.0, 1.0, 1.0, 9)], "r double, g double, b double, class int")
    own, coloured = ([(r["red"], r["green"], r["blue"], r["label"]) for r in point_files.las_records(cls, coloured=c).orderBy("label").collect()] for c in (False, True))
    assert own == [(65535, 32767, 0, 1), (65535, 65535, 65535, 9)]
    assert coloured == [(int(220 / 255 * 65535), int(60 / 255 * 65535), int(60 / 255 * 65535), 1), (0, 0, 0, 9)]


def test_tables(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1, 2, 3, 300, -5, 7, 4.0]]))
    r = point_files.read_npy_points(spark, str(tmp_path)).first()
    assert (r["x"], r["r"], r["g"], r["label"]) == (1.0, 255.0, 0.0, 4)
    (tmp_path / "t.txt").write_text("1 2 3 5\n\n 4\t5  6 7 \n")
    got = point_files.read_text_points(spark, str(tmp_path / "t.txt")).collect()
    assert [(r["z"], r["r"], r["label"]) for r in got] == [(3.0, None, 5), (6.0, None, 7)]


def las_file(path, form, length, minor, rows, vlr):
    """A LAS file made by hand: header, one variable-length record, padding, records."""
    size = {2: 227, 4: 375}[minor]
    head = bytearray(size)
    head[:4], head[24:26], head[26:58] = b"LASF", bytes((1, minor)), b"maker".ljust(32, b"\0")
    body = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(vlr), b"text") + vlr
    offset = size + len(body) + 3
    struct.pack_into("<HII", head, 94, size, offset, 1)
    struct.pack_into("<BHI5I", head, 104, form, length, *([len(rows)] * 2 if form < 6 else [0, 0]), 0, 0, 0, 0)
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.002, 600_000.0, 3_800_000.0, -5.0)
    real = [[p[a] * (0.01, 0.01, 0.002)[a] + (600_000.0, 3_800_000.0, -5.0)[a] for a in range(3)] for p in rows]
    struct.pack_into("<6d", head, 179, *[f(r[a] for r in real) for a in range(3) for f in (max, min)])
    if minor == 4:
        struct.pack_into("<16Q", head, 247, len(rows), len(rows), *[0] * 14)
    with open(path, "wb") as f:
        f.write(bytes(head) + body + b"pad")
        for x, y, z, label, r, g, b in rows:
            rec = bytearray(length)
            struct.pack_into("<3i", rec, 0, x, y, z)
            rec[16 if form >= 6 else 15] = label
            struct.pack_into("<3H", rec, {2: 20, 3: 28, 7: 30}[form], r, g, b)
            f.write(rec)


def test_las_tiles_keep_their_headers(spark, tmp_path):
    """Three tiles of several formats and versions: written and read, header and records are byte for byte those of the source."""
    source, rng = tmp_path / "source", random.Random(1)
    source.mkdir()
    for k, (form, length, minor) in enumerate([(2, 26, 2), (3, 34, 2), (7, 36, 4)]):
        rows = [(rng.randint(-10**6, 10**6), rng.randint(0, 10**6), rng.randint(0, 999), rng.randint(0, 5), *(rng.randint(0, 65535) for _ in range(3))) for _ in range(40 + k)]
        las_file(source / f"Tile_{k}.las", form, length, minor, rows, b"GEOGCS" * (k + 1))
    df = point_files.read_las(spark, str(source))
    point_files.write_las_tiles(df.repartition(3), str(tmp_path / "out"), str(source), "_preclassified")
    for k in range(3):
        assert (tmp_path / "out" / f"Tile_{k}_preclassified.las").read_bytes() == (source / f"Tile_{k}.las").read_bytes()
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == [f"Tile_{k}_preclassified.las" for k in range(3)]
    tiles = point_files.tile_sizes(spark, str(source))
    got = {r["tile"]: r for r in tiles.collect()}
    assert [(got[f"Tile_{k}.las"]["points"], got[f"Tile_{k}.las"]["bytes"], got[f"Tile_{k}.las"]["format"]) for k in range(3)] == [(40 + k, (source / f"Tile_{k}.las").stat().st_size, f) for k, f in enumerate((2, 3, 7))]
    total = compare.tile_totals(tiles).first()
    assert (total["files"], total["points"], total["mean_points"], total["bytes"]) == (3, 123, 41.0, sum(p.stat().st_size for p in source.iterdir()))
    with pytest.raises(Exception, match="unknown|No such|not"):
        point_files.write_las_tiles(df.withColumn("tile", F.lit("unknown.las")), str(tmp_path / "bad"), str(source))


def test_positions_are_checked(spark):
    p = spark.createDataFrame([(i, float(i)) for i in range(5)], "idx long, x double")
    q = spark.createDataFrame([(i, i % 2) for i in range(5)], "idx long, pred int")
    assert sorted((r["idx"], r["pred"]) for r in points.with_predictions(p, q).collect()) == [(i, i % 2) for i in range(5)]
    for wrong in (q.where("idx < 4"), q.union(q.limit(1)), q.withColumn("idx", F.col("idx") + 1)):
        with pytest.raises(ValueError):
            points.with_predictions(p, wrong)


def test_tile_averages(spark):
    df = spark.createDataFrame([("a", 0.5, 10), ("b", 0.7, 30)], "tile string, oa double, raw long")
    assert compare.tile_averages(df, ("oa",), ("raw",)).first().asDict() == pytest.approx({"oa": 0.6, "raw": 40})
