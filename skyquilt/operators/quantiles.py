"""Exact quantiles of whole columns, in passes over ever narrower ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, FEW = 1024, 50_000  # bins of a range in a pass; values of one range that are sorted at last


@dataclass
class _Range:
    """Values of a feature from ``low`` to ``high``: ``n`` of them, after ``before`` smaller ones; ``ranks`` are those asked for."""

    feature: str
    low: float
    high: float
    before: int
    n: int
    ranks: set[int]


def _rows(values: DataFrame, ranges: list[_Range]) -> DataFrame:
    """The values that lie in the ranges, which are a few a feature and are sent along."""
    told = values.sparkSession.createDataFrame([(r.feature, i, r.low, r.high) for i, r in enumerate(ranges)], "feature string, i int, low double, high double")
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    return values.alias("v").join(F.broadcast(told.alias("r")), (F.col("v.feature") == F.col("r.feature")) & inside).select("i", "v", "low", "high")


def exact_quantiles(points: DataFrame, columns: Sequence[str], quantiles: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column the values at these shares of its order, between two neighbours in proportion.

    A pass counts the values of every open range in bins of equal width, with each
    bin's least and largest value; only bins that hold a wanted rank stay open,
    between these two values.  A range of one value is settled, one of ``FEW``
    values is sorted at last.  So a task holds counts of bins or ``FEW`` values,
    never the values of a column; each pass narrows ranges by ``BINS`` at least.
    Null and NaN are left out; a column without values gives nulls.
    """
    values = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*").where("v is not null and not isnan(v)")
    at: dict[str, dict[int, float]] = {c: {} for c in columns}
    whole = {r["feature"]: r for r in values.groupBy("feature").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    place = {c: [q * (whole[c]["n"] - 1) for q in quantiles] for c in columns if c in whole}
    opened = [_Range(c, w["low"], w["high"], 0, w["n"], {f(p) for p in place[c] for f in (floor, ceil)}) for c, w in whole.items()]
    few: list[_Range] = []
    while opened:
        for r in opened:
            if r.low == r.high:
                at[r.feature] |= dict.fromkeys(r.ranks, r.low)
        few += [r for r in opened if r.low < r.high and r.n <= FEW]
        opened = [r for r in opened if r.low < r.high and r.n > FEW]
        if not opened:
            break
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves, as a difference may be too large
        binned = _rows(values, opened).select("i", "v", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
        counts = binned.groupBy("i", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        found = []
        for i, r in enumerate(opened):
            before = r.before
            for b in sorted((c for c in counts if c["i"] == i), key=lambda c: c["bin"]):
                ranks = {k for k in r.ranks if before <= k < before + b["n"]}
                if ranks:
                    found.append(_Range(r.feature, b["low"], b["high"], before, b["n"], ranks))
                before += b["n"]
        opened = found
    if few:
        ranked = _rows(values, few).withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("v")) - 1)
        wanted = points.sparkSession.createDataFrame([(i, k - r.before) for i, r in enumerate(few) for k in r.ranks], "i int, k int")
        for row in ranked.join(F.broadcast(wanted), ["i", "k"]).select("i", "k", "v").collect():
            at[few[row["i"]].feature][few[row["i"]].before + row["k"]] = row["v"]

    def between(c: str, p: float) -> float:
        low, high = at[c][floor(p)], at[c][ceil(p)]
        return low if low == high else low * (ceil(p) - p) + high * (p - floor(p))

    return {c: [between(c, p) for p in place[c]] if c in place else [None] * len(quantiles) for c in columns}
