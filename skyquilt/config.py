"""Settings of the pipelines, with the defaults of the command line tools they stand for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Camera:
    """Interior orientation; one camera serves a whole run."""

    focal_mm: float = 35.0
    sensor_width_mm: float = 36.0
    sensor_height_mm: float = 24.0
    image_width_px: int = 8192
    image_height_px: int = 5460
    principal_x_px: float | None = None
    principal_y_px: float | None = None

    def __post_init__(self):
        if min(self.focal_mm, self.sensor_width_mm, self.sensor_height_mm, self.image_width_px, self.image_height_px) <= 0:
            raise ValueError("camera sizes must be positive")

    @property
    def fx(self) -> float:
        return self.focal_mm * self.image_width_px / self.sensor_width_mm

    @property
    def fy(self) -> float:
        return self.focal_mm * self.image_height_px / self.sensor_height_mm

    @property
    def cx(self) -> float:
        return self.image_width_px / 2 if self.principal_x_px is None else self.principal_x_px

    @property
    def cy(self) -> float:
        return self.image_height_px / 2 if self.principal_y_px is None else self.principal_y_px


@dataclass(frozen=True)
class ScreeningConfig:
    camera: Camera | None = None
    nadir_pitch: float = -90.0
    gimbal_yaw_relative: bool = False
    area: tuple[float, float, float, float] | None = None
    area_lonlat: tuple[float, float, float, float] | None = None
    area_margin: float = 50.0
    grid_size: float = 20.0
    ref_elevation: float = 0.0
    ref_lon: float | None = None
    ref_lat: float | None = None
    alpha: float = 0.5
    beta: float = 0.5
    threshold: float = 0.10
    allow_gaps: bool = False


@dataclass(frozen=True)
class ClassifyConfig:
    """Thresholds of the class rules, in the order in which the rules ask."""

    ground_cell: float = 1.0
    ground_percentile: float = 0.05
    ground_min_points: int = 5
    voxel: float = 0.5
    green_exg: float = 0.03
    green_dominance: float = 0.01
    tree_height: float = 0.4
    tree_exg: float = 0.01
    tree_roughness: float = 0.06
    building_height: float = 1.5
    roof_planarity: float = 0.35
    roof_roughness: float = 0.15
    wall_verticality: float = 0.25
    wall_saturation: float = 0.18
    ground_height: float = 0.25
    road_brightness: float = 0.45
    road_roughness: float = 0.05
    road_saturation: float = 0.10
    soil_red_excess: float = 0.015
    soil_brightness: float = 0.25
    other_height: float = 0.20
