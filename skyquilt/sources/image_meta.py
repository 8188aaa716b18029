"""Position, attitude and camera from the metadata inside image files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.geometry import yaw

# The names by which makers write a number, in order of trust.
XMP_NUMBERS = {
    "pitch": ("GimbalPitchDegree", "GimbalPitch"),
    "roll": ("GimbalRollDegree", "GimbalRoll"),
    "gimbal_yaw": ("GimbalYawDegree", "GimbalYaw"),
    "flight_yaw": ("FlightYawDegree", "FlightYaw", "Yaw"),
    "absolute_alt": ("AbsoluteAltitude",),
    "relative_alt": ("RelativeAltitude",),
    "lat": ("Latitude", "GpsLatitude"),
    "lon": ("Longitude", "GpsLongitude"),
}
# Tag numbers of the TIFF and EXIF standards.
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
TAGS = {0x010F: "make", 0x0110: "model", 0x0100: "width0", 0x0101: "height0", 0xA002: "width", 0xA003: "height", 0x920A: "focal", 0xA405: "focal35", 0xA20E: "plane_x", 0xA20F: "plane_y", 0xA210: "plane_unit"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def read_tiff_tags(data: bytes) -> dict:
    """The tags of a TIFF block that are needed here; what cannot be read is left out."""
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        return {}
    order = "<" if data[:2] == b"II" else ">"
    out: dict = {}

    def value(kind: int, count: int, at: int):
        raw = data[at : at + SIZES[kind] * count]
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "ignore").strip()
        if kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            return [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        return list(struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B', 9: 'i'}[kind] }", raw))

    def directory(at: int, names: dict) -> None:
        n = struct.unpack_from(order + "H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in SIZES or tag not in names and tag not in (EXIF_POINTER, GPS_POINTER):
                continue
            place = at + 10 + 12 * k
            if SIZES[kind] * count > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            got = value(kind, count, place)
            if tag == EXIF_POINTER and names is TAGS:
                directory(got[0], TAGS)
            elif tag == GPS_POINTER and names is TAGS:
                directory(got[0], GPS_TAGS)
            elif tag in names:
                out[("gps_" if names is GPS_TAGS else "") + names[tag]] = got

    try:
        directory(struct.unpack_from(order + "I", data, 4)[0], TAGS)
    except (struct.error, IndexError, KeyError):
        pass
    return out


def exif_numbers(content: bytes) -> dict:
    """Position and camera of one image."""
    at = content.find(b"Exif\0\0")
    tags = read_tiff_tags(content[at + 6 :] if at >= 0 else content)
    first = lambda name: (tags.get(name) or [None])[0] if not isinstance(tags.get(name), str) else None

    def degrees(name: str, negative: str):
        parts = tags.get(f"gps_{name}")
        if not isinstance(parts, list) or None in parts or not parts:
            return None
        size = sum(p / 60**i for i, p in enumerate(parts[:3]))
        return -size if str(tags.get(f"gps_{name}_ref", "")).upper().startswith(negative) else size

    alt = first("gps_alt")
    if alt is not None and first("gps_alt_ref") == 1:
        alt = -alt
    width, height = first("width") or first("width0"), first("height") or first("height0")
    focal, full = first("focal"), first("focal35")
    sensor_w = sensor_h = None
    if focal and full and width and height:  # the diagonal of 36 x 24 mm, shrunk by the crop
        diagonal = (36.0**2 + 24.0**2) ** 0.5 * focal / full
        sensor_w, sensor_h = (diagonal * s / (width**2 + height**2) ** 0.5 for s in (width, height))
    elif first("plane_x") and width and height:  # pixels per unit of 2: inch, 3: centimetre
        unit = {2: 25.4, 3: 10.0}.get(first("plane_unit") or 2, 25.4)
        sensor_w, sensor_h = width * unit / first("plane_x"), height * unit / (first("plane_y") or first("plane_x"))
    text = lambda name: tags.get(name) if isinstance(tags.get(name), str) else None
    return {"lat": degrees("lat", "S"), "lon": degrees("lon", "W"), "alt": alt, "width": width, "height": height, "focal_mm": focal, "focal_35": full, "sensor_width_mm": sensor_w, "sensor_height_mm": sensor_h, "make": text("make"), "model": text("model")}


EXIF_SCHEMA = "path string, lat double, lon double, alt double, width double, height double, focal_mm double, focal_35 double, sensor_width_mm double, sensor_height_mm double, make string, model string, xmp string"


def xmp_slice(content: bytes) -> str:
    begin = next((i for i in (content.find(b"<x:xmpmeta"), content.find(b"<xmpmeta")) if i >= 0), -1)
    ends = [i + len(mark) for mark in (b"</x:xmpmeta>", b"</xmpmeta>") if begin >= 0 and (i := content.find(mark, begin)) >= 0]
    return content[begin : ends[0]].decode("utf-8", "ignore") if ends else ""


def read_headers(files: DataFrame) -> DataFrame:
    """EXIF numbers and the XMP text of the files of a ``binaryFile`` table; only these leave the task."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"path": p, **exif_numbers(c), "xmp": xmp_slice(c)} for p, c in zip(frame["path"], frame["content"], strict=True)], columns=[f.split()[0] for f in EXIF_SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(read, EXIF_SCHEMA)


# A qualified name, by the XML grammar as far as metadata uses it: prefix, colon, local part.
_PART = r"[\w.-]+"
_ELEMENT = rf"<({_PART}:{_PART})(?:\s[^<>]*)?>([^<>]+)</\1\s*>"  # closed under the same name
_ATTRIBUTE = rf"(?<![\w.:-])({_PART}:{_PART})\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)')"


def named_values(text: Column, pattern: str, values: int) -> Column:
    """Array of ``tag`` (group 1) and ``value`` (whichever of the next ``values`` groups matched)."""
    tags, *found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(1, values + 2)]
    joined = reduce(lambda a, b: F.zip_with(a, b, lambda p, q: F.concat(p, q)), found)
    return F.arrays_zip(tags, joined).cast("array<struct<tag: string, value: string>>")


def all_tags(rows: DataFrame, key: str, text: str, element: str = _ELEMENT, attribute: tuple[str, int] = (_ATTRIBUTE, 2)) -> DataFrame:
    """``key, tag, value`` of every namespaced element that holds text, and of every attribute."""
    found = F.concat(named_values(F.col(text), element, 1), named_values(F.col(text), *attribute))
    return rows.select(key, F.explode(found).alias("t")).select(key, "t.*")


def xmp_numbers(text: Column) -> dict[str, Column]:
    """The numbers of ``XMP_NUMBERS``: of the names of each, in their order, the first with a number, as an element before as an attribute.

    The text is read twice, into its elements and its attributes by local name;
    names are then looked up.
    """
    def by_name(pairs: Column) -> Column:
        return F.transform(pairs, lambda p: F.struct(F.substring_index(p["tag"], ":", -1).alias("name"), F.trim(p["value"]).try_cast("double").alias("number")))

    sources = by_name(named_values(text, _ELEMENT, 1)), by_name(named_values(text, _ATTRIBUTE, 2))

    def first(name: str) -> list[Column]:
        return [F.get(F.filter(tags, lambda t: (t["name"] == name) & t["number"].isNotNull()), F.lit(0))["number"] for tags in sources]

    return {field: F.coalesce(*[c for name in names for c in first(name)]) for field, names in XMP_NUMBERS.items()}


def merge_metadata(headers: DataFrame, nadir_pitch: float = -90.0, yaw_relative: bool = False) -> DataFrame:
    """One record an image: position from EXIF, else XMP; height from EXIF, else absolute, else relative, else 0; angles from XMP.

    ``no_yaw`` marks images that have XMP but no heading; theirs is taken as 0.
    """
    read = headers.withColumn("x_", F.struct(*[c.alias(k) for k, c in xmp_numbers(F.col("xmp")).items()]))
    have = F.length("xmp") > 0
    kappa = yaw(F.col("x_.gimbal_yaw"), F.col("x_.flight_yaw"), yaw_relative)
    return read.select(
        F.col("path").alias("file"), F.coalesce("lon", "x_.lon").alias("lon"), F.coalesce("lat", "x_.lat").alias("lat"),
        F.coalesce("alt", "x_.absolute_alt", "x_.relative_alt", F.lit(0.0)).alias("z"),
        F.coalesce("x_.roll", F.lit(0.0)).alias("omega"), F.coalesce(F.col("x_.pitch") - nadir_pitch, F.lit(0.0)).alias("phi"), F.coalesce(kappa, F.lit(0.0)).alias("kappa"),
        (have & kappa.isNull()).alias("no_yaw"), "focal_mm", "sensor_width_mm", "sensor_height_mm", F.col("width").cast("int").alias("image_width_px"), F.col("height").cast("int").alias("image_height_px"), "make", "model",
    )
