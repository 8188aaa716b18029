"""Global positions of rows without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.storage import Scratch

LOCAL = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def ranged(scratch: Scratch, rows: DataFrame, order: Sequence[Column | str], per_range: int | None = None) -> DataFrame:
    """``rows`` as a table in the given order, with ``_p``, the number of the range, and ``_i``, the place in it.

    Ranges hold about as many rows each, also where many rows are equal in
    ``order``: the row's number in the input comes last, so equal rows fill
    several ranges.  With ``per_range`` there are as many ranges as it takes to
    hold about so many rows each.  The input should be a scan or a table of
    ``scratch``, as it is read twice, for the bounds of the ranges and for the rows.
    """
    last = "_last"
    known = [max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_range))] if per_range else []
    dealt = rows.withColumn(last, F.monotonically_increasing_id()).repartitionByRange(*known, *order, last).sortWithinPartitions(*order, last).drop(last)
    return scratch.save(dealt.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(LOCAL)}))


def numbered(scratch: Scratch, rows: DataFrame, order: Sequence[Column | str], name: str = "at") -> DataFrame:
    """``rows`` with their position from 0 in the given order: the rows before a range, from the counts of the ranges, and the place in it.

    Only the counts, one row a range, are summed in one task and sent along.
    """
    placed = ranged(scratch, rows, order)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")
