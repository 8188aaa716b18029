"""Camera geometry and plane geometry as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyquilt.config import Camera

METRES_PER_DEGREE_LON, METRES_PER_DEGREE_LAT = 111320.0, 110540.0
EDGE_TOLERANCE = 1e-9


def yaw(gimbal: Column, flight: Column, relative: bool = False) -> Column:
    """Heading in [0, 360): the gimbal's, plus the aircraft's if it is relative to that; the aircraft's where the gimbal's is missing."""
    both = gimbal + flight if relative else gimbal
    return F.pmod(F.coalesce(both, gimbal, flight), F.lit(360.0))


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, on an equirectangular plane."""
    return (lon - lon0) * METRES_PER_DEGREE_LON * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE_LAT


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def footprint(camera: Camera, x: Column, y: Column, z: Column, omega: Column, phi: Column, kappa: Column, z_ref: float = 0.0) -> Column:
    """The image's corners on the plane z = z_ref, from the upper left clockwise; null if a corner's ray meets no ground.

    A pixel is turned by omega in the image, tilted by phi away from the vertical
    and headed by kappa, clockwise from north.
    """
    w, h = float(camera.image_width_px), float(camera.image_height_px)
    pixels = [((u - camera.cx) / camera.fx, (v - camera.cy) / camera.fy) for u, v in ((0.0, 0.0), (w, 0.0), (w, h), (0.0, h))]
    so, co, sp, cp, sk, ck = (f(F.radians(a)) for a in (omega, phi, kappa) for f in (F.sin, F.cos))
    turned = F.array(*[F.struct((co * dx - so * dy).alias("a"), (so * dx + co * dy).alias("b")) for dx, dy in pixels])
    tilted = F.transform(turned, lambda p: F.struct(p["a"].alias("a"), (sp - cp * p["b"]).alias("q"), (-(sp * p["b"] + cp)).alias("down")))
    headed = F.transform(tilted, lambda p: F.struct((ck * p["a"] + sk * p["q"]).alias("e"), (ck * p["q"] - sk * p["a"]).alias("n"), F.when(F.abs(p["down"]) >= 1e-9, (F.lit(z_ref) - z) / p["down"]).alias("t")))
    placed = F.transform(headed, lambda p: F.when(p["t"] >= 0, F.struct((x + p["t"] * p["e"]).alias("x"), (y + p["t"] * p["n"]).alias("y"))))
    whole = lambda p: F.coalesce(p.isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False))
    return bound(placed, lambda polygon: F.when(F.forall(polygon, whole), polygon))


def polygon_area(polygon: Column, corners: int = 4) -> Column:
    """Shoelace area of a polygon with a known number of corners."""
    def cross(i: int) -> Column:
        p, q = polygon[i], polygon[(i + 1) % corners]
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.abs(reduce(lambda a, b: a + b, map(cross, range(corners)))) / 2


def bbox(polygon: Column) -> dict[str, Column]:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def in_corners(px: Column, py: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a point lies in the polygon of these corners, by the even-odd rule, its boundary included."""
    inside, on_edge = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        dy = by - ay
        cross = (bx - ax) * (py - ay) - dy * (px - ax)
        spans = (ay > py) != (by > py)
        # the ray to the right meets the edge where the point is on its left, seen upwards
        inside = inside != (spans & F.when(dy > 0, cross > 0).otherwise(cross < 0))
        near = px.between(F.least(ax, bx) - EDGE_TOLERANCE, F.greatest(ax, bx) + EDGE_TOLERANCE)
        near &= py.between(F.least(ay, by) - EDGE_TOLERANCE, F.greatest(ay, by) + EDGE_TOLERANCE)
        on_edge |= near & (F.abs(cross) <= EDGE_TOLERANCE)
    return inside | on_edge


def in_polygon(px: Column, py: Column, polygon: Column, corners: int = 4) -> Column:
    """``in_corners`` for an array of x and y."""
    return in_corners(px, py, [(polygon[k]["x"], polygon[k]["y"]) for k in range(corners)])


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of two axis-aligned boxes, each four columns behind a prefix; 0 for two empty boxes."""
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")), F.lit(0.0))
    area = lambda p: (F.col(f"{p}xmax") - F.col(f"{p}xmin")) * (F.col(f"{p}ymax") - F.col(f"{p}ymin"))
    both = side("xmin", "xmax") * side("ymin", "ymax")
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def square_around(x: Column, y: Column, side: Column) -> Column:
    half = side / 2
    return F.array(*[F.struct((x + sx * half).alias("x"), (y + sy * half).alias("y")) for sx, sy in ((-1, 1), (1, 1), (1, -1), (-1, -1))])


def vertical_sides(height: Column, camera: Camera) -> tuple[Column, Column]:
    """Ground size of a vertical view."""
    return height * camera.sensor_width_mm / camera.focal_mm, height * camera.sensor_height_mm / camera.focal_mm
