"""Colour expressions; channels from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_channel(c: Column, depth: float = 255.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / depth))


def las_channel(c: Column, file_max: Column) -> Column:
    """0..255 from a LAS channel: 16-bit files, whose largest value is above 255, are divided by 257."""
    scaled = F.when(file_max > 255, c / 257.0).otherwise(c.cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def green_dominance(r: Column, g: Column, b: Column) -> Column:
    return g - F.greatest(r, b)


def brightness(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3


def saturation(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)
