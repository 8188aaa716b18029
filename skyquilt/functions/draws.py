"""Random numbers that a hash of what they are for decides, so that no partitioning or retry changes them."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(seed: int, salt: int, *what: Column) -> Column:
    """A number from 0 to 1."""
    return F.xxhash64(F.lit(seed), F.lit(salt), *what) / F.lit(2.0**64) + 0.5


def normal(seed: int, salt: int, *what: Column) -> Column:
    """A number of the standard normal distribution, from two of ``unit``."""
    size = F.sqrt(-2 * F.log(F.greatest(unit(seed, 2 * salt, *what), F.lit(1e-300))))
    return size * F.cos(2 * pi * unit(seed, 2 * salt + 1, *what))
