import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHEAP = ["footprints", "coverage_pairs", "coverage_scores", "voxel_mean", "voxel_mode", "voxel_first", "ground_percentile", "height_above_ground", "class_metrics", "knn", "dbscan_labels", "blocks", "box_iou_pairing"]


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(v[i]) if isinstance(v[i], (int, float)) and not isinstance(v[i], bool) else v[i] for i in order]) for v in values)


def test_names():
    assert entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["idx", "covered", "base_ratio", "new_ratio", "score"]


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
