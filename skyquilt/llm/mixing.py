"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SLOT_DIGITS = 3  # hexadecimal digits: 4096 slots for each source


def water_fill(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Adds ``target`` to ``source, source_size``, one row per source.

    Sources by code point, null last, weigh ``weights``, repeating, and share
    100 % of all sizes.  A source whose share is above ``max_epochs`` times its
    size is clamped there and the excess is shared by weight again, until no
    share is above.  With the sources in order of cap per unit of weight, the
    clamped ones come first, so the repeated sharing ends at the first source
    whose cap exceeds the level of what is left; running sums give that level
    without a loop.  The table has a row per source, so one window over all of
    it stays small.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumns({
        "weight": F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1),
        "cap": F.col("source_size") * F.lit(int(max_epochs)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    level = (F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("clamped", F.col("cap") / F.col("weight") <= F.col("level"))
    last = F.max(F.when(~F.col("clamped"), F.col("level"))).over(Window.partitionBy())
    return ranked.withColumn("last_level", last).select(
        "source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("last_level") * F.col("weight")).alias("target")
    )


def slot_of(doc_id: Column, seed: int) -> Column:
    """A document's place in the seeded order of its source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, SLOT_DIGITS), 16, 10).cast("int")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """How many words of each document a mix takes, repeats counted.

    Returns, per row of ``docs``: the id, ``size`` (words), ``source_size``,
    ``target`` (see ``water_fill``), ``repeats`` (whole passes over the
    document), ``part`` (words of a last, partial pass) and ``taken`` = size *
    repeats + part.  The whole part of target / source_size is taken of every
    document.  The fraction is a seeded sample: documents fall into slots by a
    hash of seed and id, slots are taken in order until the fraction is used up,
    and documents of the slot at the boundary are taken in part, so a source
    misses its target by less than one word for each document of one slot.

    Null text: size 0.  Null source: a source of its own, last in order.  Null
    id: an id like any other.  Repeated rows count as documents each, in one
    slot.  Empty table: no rows.  Other columns are ignored, whatever their
    names.  Only (source, slot) sums are shuffled for the shares, so a source
    with a third of all rows is 4096 keys; the text is read once.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        slot_of(F.col(id_col), seed).alias("slot"),
    ))
    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    targets = water_fill(slots.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    running = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    plan = slots.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("p_source"), F.col("slot").alias("p_slot"), "words", "before", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int").alias("repeats"),
    ).withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size") - F.col("before"))
    part = F.when((F.col("left") <= 0) | (F.col("words") == 0), F.lit(0)).when(F.col("left") >= F.col("words"), F.col("size")).otherwise(F.floor(F.col("size") * F.col("left") / F.col("words"))).cast("long")
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slot") == F.col("p_slot")))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "repeats", part.alias("part"))
        .withColumn("taken", F.col("size") * F.col("repeats") + F.col("part"))
    )


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS slot
  FROM documents),
slots AS (SELECT source, slot, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, slot),
sources AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk
  FROM slots GROUP BY source),
ranked AS (
  SELECT source, source_size, rnk, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM sources),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM ranked),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap / weight <= lvl THEN CAST(cap AS DOUBLE)
              ELSE max(CASE WHEN cap / weight <= lvl THEN NULL ELSE lvl END) OVER () * weight END AS target
  FROM levels),
plan AS (
  SELECT s.source, s.slot, s.words, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS INTEGER) ELSE 0 END AS repeats,
         CAST(coalesce(sum(s.words) OVER (PARTITION BY s.source ORDER BY s.slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM slots s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rest AS (SELECT *, target - repeats * source_size - before AS remaining FROM plan)
SELECT d.doc_id, d.size, r.source_size, r.target,
       d.size * r.repeats + CASE WHEN r.remaining <= 0 OR r.words = 0 THEN 0 WHEN r.remaining >= r.words THEN d.size
                                 ELSE CAST(floor(d.size * r.remaining / r.words) AS BIGINT) END AS taken
FROM sized d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source AND d.slot = r.slot
"""
