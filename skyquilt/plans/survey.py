"""Whole runs: screening a survey, classifying a cloud and extracting its buildings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.config import ClassifyConfig, ScreeningConfig
from skyquilt.operators import cluster, points, screening
from skyquilt.storage import saved


@dataclass(frozen=True)
class Screening:
    grid: screening.Grid
    footprints: DataFrame
    cover: DataFrame
    scores: DataFrame
    kept: DataFrame


def screen(pos: DataFrame, config: ScreeningConfig = ScreeningConfig()) -> Screening:
    """Footprints, coverage, scores and selection of the records ``pos``.

    If the first record (by ``idx``) has x and y, all are taken in these metres;
    else x and y are computed from lon and lat around the given origin, or the
    mean of all.  Records without a place are left out.  ``area_lonlat`` is turned
    into metres around the same origin, so it needs lon and lat in the records or
    a given origin.
    """
    origin = screening.origin_of(pos, config.ref_lon, config.ref_lat) if {"lon", "lat"} <= set(pos.columns) else (config.ref_lon, config.ref_lat)
    if not screening.is_plane(pos):
        pos = screening.localise(pos, *origin)
    pos = pos.where("x is not null and y is not null")
    camera = screening.resolve_camera(pos, config.camera)
    prints = saved(screening.footprints(pos, camera, config.ref_elevation))
    grid = screening.make_grid(*screening.study_area(prints, config, origin), config.grid_size)
    cover = saved(screening.coverage(prints, grid))
    scores = screening.contribution(prints, cover, grid.cells, config.alpha, config.beta)
    kept = screening.select_images(scores, config.threshold)
    if not config.allow_gaps:
        kept = screening.repair_gaps(kept, cover)
    return Screening(grid, prints, cover, scores, kept)


def extract_buildings(cloud: DataFrame, eps: float = 2.0, min_samples: int = 20, building: int = 1, column: str = "class") -> DataFrame:
    """Building targets of a classified cloud."""
    chosen = cloud.where(F.col(column) == building)
    return cluster.targets(chosen, cluster.dbscan(chosen, eps, min_samples))


def classify_and_extract(cloud: DataFrame, config: ClassifyConfig = ClassifyConfig(), eps: float = 2.0, min_samples: int = 20) -> DataFrame:
    return extract_buildings(points.classify(cloud, config), eps, min_samples)
