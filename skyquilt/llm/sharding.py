"""Shards of a corpus by a seeded permutation of its row numbers, in DataFrame operations only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.operators.numbering import numbered
from skyquilt.storage import Scratch

ROUNDS = 4
DIGITS = 15  # hexadecimal digits of a round's hash: 60 bits


class Permutation:
    """A keyed permutation of 0 .. n - 1 as Column expressions: a Feistel network with cycle walking.

    A number x is a place (left, right) in a grid of a * b >= n cells, as near a
    square as can be.  Each round adds a hash of one half to the other, so the
    grid is permuted; a result outside 0 .. n - 1 goes through again until it is
    inside.  The grid has fewer than sqrt(n) + 1 cells too many, each of which a
    walk meets once at most, so walks are rare and end within that many steps.
    """

    def __init__(self, n: int, seed: int):
        self.n, self.seed = n, seed
        self.a = max(1, isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))

    def _hash(self, i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), i.cast("string"), half.cast("string"))), 1, DIGITS), 16, 10).cast("long")

    def _once(self, x: Column, back: bool) -> Column:
        """One pass through all rounds, or back through them."""
        add = (lambda half, h, size: F.pmod(half - h, size)) if back else (lambda half, h, size: F.pmod(half + h, size))
        a, b = F.lit(self.a).cast("long"), F.lit(self.b).cast("long")
        halves = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(add(s["l"], self._hash(i, s["r"]), a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), add(s["r"], self._hash(i, s["l"]), b).alias("r")))

        order = range(ROUNDS)
        return F.aggregate(F.array(*map(F.lit, reversed(order) if back else order)), halves, turn, lambda s: s["l"] * b + s["r"])

    def _walk(self, x: Column, back: bool) -> Column:
        outside = self.a * self.b - self.n
        once = self._once(x, back)
        if not outside:
            return once
        again = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), once, lambda y, _: F.when(y < self.n, y).otherwise(self._once(y, back)))
        return F.when(once < self.n, once).otherwise(again)

    def forward(self, x: Column) -> Column:
        return self._walk(x, False)

    def backward(self, y: Column) -> Column:
        return self._walk(y, True)


def place(row: Column, order: Permutation, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a global row number."""
    y = order.forward(row)
    return F.pmod(y, F.lit(shards)).cast("int"), F.floor(y / shards).cast("long")


def row_at(shard: Column, slot: Column, order: Permutation, shards: int) -> Column:
    """The global row number that stands in a slot of a shard."""
    return order.backward(slot.cast("long") * shards + shard.cast("long"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """What orders rows: the id, then the text by two checksums; and the row's size."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "id": F.col(id_col), "crc": F.crc32(text.cast("binary")),
        "digest": F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long"), "size": F.octet_length(text).cast("long") + 1,
    }


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_first(), F.col("size"), F.col("crc"), F.col("digest")]


def assign_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 17) -> DataFrame:
    """The shard and slot of every row by a seeded shuffle that anyone can compute again.

    Rows are numbered from 0 by id, then by their text's size and checksums (no
    task sees all rows, see ``numbered``); a Feistel permutation of all numbers
    then says where each goes: number y stands in slot y // shards of shard
    y % shards.  So shards' row counts are at most one apart, slots have no gaps,
    the law is ``rows``, and nothing but the row numbers, their count, the seed
    and the number of shards decides; ``row_at`` gives the row of a slot.

    Returns, per row of ``docs``: the id, ``size`` (UTF-8 bytes of the text and
    1), ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null:
    with another number of shards rows move freely under this law).

    Null text: as an empty one, size 1.  Null ids come first.  Repeated rows are
    rows of their own in slots of their own, and so are equal texts, which this
    law spreads over all shards.  Empty table: no rows.  Other columns are
    ignored, whatever their names.  A text is read once; what is shuffled is four
    numbers a row, in ranges of equal size however often an id or a text repeats.
    """
    scratch = Scratch(docs.sparkSession)
    sized, seen = scratch.save_counted(docs.select(*[c.alias(n) for n, c in _keys(docs, id_col, text_col).items()]), n=F.count("*"))
    at = numbered(scratch, sized, _order(), "row")
    shard, slot = place(F.col("row"), Permutation(seen["n"], seed), shards)
    return at.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 17) -> None:
    """Writes whole rows to ``path`` as Parquet, one folder a shard, its files in order of slots: columns ``slot`` and ``row`` (all of ``docs``).

    Shards and slots are those of ``assign_shards``.  A shard is as many files as
    it has ranges of slots, so no task holds a shard.
    """
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in _keys(docs, id_col, text_col).items()])
    at = numbered(scratch, whole, _order(), "at")
    shard, slot = place(F.col("at"), Permutation(docs.count(), seed), shards)
    placed = scratch.save(at.select(shard.alias("shard"), slot.alias("slot"), "row"))
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


CRC_SQL = """
crc_table AS (SELECT list(list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))
"""


def crc_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes in SQL; ``t`` of ``crc_table`` must be in reach."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _round_sql(i: int) -> str:
    half, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
    return f"({half} + CAST('0x' || substr(md5('17:{i}:' || {other}), 1, {DIGITS}) AS BIGINT)) % {size} AS {half}, {other}"


def _rounds_sql() -> str:
    inner = "(SELECT seat, x // b AS l, x % b AS r, a, b, n FROM walk CROSS JOIN grid WHERE NOT done)"
    for i in range(ROUNDS):
        inner = f"(SELECT seat, {_round_sql(i)}, a, b, n FROM {inner})"
    return inner


SQL = f"""
WITH RECURSIVE {CRC_SQL.strip()},
sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, {DIGITS}) AS BIGINT) AS digest
  FROM documents CROSS JOIN crc_table),
rows_ AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32, digest) - 1 AS seat FROM sized),
grid AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS a FROM sized)),
walk(seat, x, done) AS (
  SELECT seat, CAST(seat AS BIGINT), false FROM rows_
  UNION ALL SELECT seat, l * b + r, l * b + r < n FROM {_rounds_sql()})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 8 AS INTEGER) AS shard, CAST(x // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows_ JOIN walk USING (seat) WHERE done
"""
