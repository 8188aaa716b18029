"""A Merkle manifest of a dataset: a hash tree for each group, a tree over the groups, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.llm.sharding import CRC_SQL, crc_sql
from skyquilt.operators.numbering import numbered, ranged
from skyquilt.storage import Scratch

RUN = 16  # nodes that have one parent
PER_RANGE = 1 << 17  # rows of one range, which one task holds


def row_digest(columns: Sequence[Column]) -> Column:
    """The digest of a row: of each value ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s), F.lit(":"), s))

    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (``before, after`` for each level) lead to."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]).cast("binary"), 256))


def _h(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _height(n: int) -> int:
    return next(k for k in count() if RUN**k >= n)


class Part:
    """The nodes of one group's tree that one range of its leaves decides: all complete runs, level by level.

    Leaves ``before`` to ``before + len(leaves)`` of ``total`` are here; ``levels``
    holds, for each level, the number of the first node and the digests.
    """

    def __init__(self, leaves: list[str], before: int, total: int):
        self.total, self.height = total, _height(total)
        self.levels = [(before, leaves)]
        for k in range(self.height):
            low, nodes = self.levels[-1]
            first = -(-low // RUN)
            last = -(-(low + len(nodes)) // RUN) if low + len(nodes) == self.width(k) else (low + len(nodes)) // RUN
            self.levels.append((first, [_h("".join(nodes[j * RUN - low : (j + 1) * RUN - low])) for j in range(first, last)]))

    def width(self, k: int) -> int:
        """Nodes of level k in the whole tree."""
        return -(-self.total // RUN**k)

    def run(self, k: int, up: int) -> list[str] | None:
        """The nodes of level k below node ``up``, if this range has them all."""
        first, made = self.levels[k + 1]
        if not first <= up < first + len(made):
            return None
        low, nodes = self.levels[k]
        return nodes[up * RUN - low : (up + 1) * RUN - low]

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """Level, number and digest of the nodes whose parent is not complete here, and of the top."""
        for k, (low, nodes) in enumerate(self.levels):
            first, made = self.levels[k + 1] if k < self.height else (0, [])
            for j, node in enumerate(nodes, low):
                if not made or not first <= j // RUN < first + len(made):
                    yield k, j, node


def _parts(rows: pd.DataFrame, told: pd.DataFrame) -> Iterator[tuple]:
    """The segments of a range, in order: what is told of the group, its rows, and its ``Part``."""
    rows = rows.sort_values("_i")
    told = {t.g: t for t in told[told["kind"] == "segment"].itertuples()}
    for g, some in rows.groupby("g", sort=False):
        yield told[g], some, Part(some["leaf"].tolist(), int(told[g].before), int(told[g].total))


def _boundary(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    out = [(t.p, t.g, t.total, k, j, node) for t, _, part in _parts(rows, told) for k, j, node in part.ragged()]
    return pd.DataFrame(out, columns=["p", "g", "total", "level", "at", "digest"])


def _paths(rows: pd.DataFrame, told: pd.DataFrame, root: str, groups: int, proofs: bool) -> pd.DataFrame:
    """The result's rows of a range: runs that are complete here are built again, those above them were told."""
    above = {(t.g, int(t.level), int(t.up)): list(t.run) for t in told[told["kind"] == "run"].itertuples()}
    top = _height(groups)
    columns: dict[str, list] = {c: [] for c in ("subroot", "proof_sha256", "folded_root", *(["proof"] if proofs else []))}

    def path(part: Part | None, g: str | None, k: int, at: int, rest: list[tuple[str, str]], known: dict) -> list[tuple[str, str]]:
        """What stands before and after a node of level k in its run, and so on for its parents."""
        if k == (part.height if part else top):
            return rest
        up = at // RUN
        run = (part and part.run(k, up)) or above[g, k, up]
        if (k + 1, up) not in known:
            known[k + 1, up] = path(part, g, k + 1, up, rest, known)
        here = at - up * RUN
        return [("".join(run[:here]), "".join(run[here + 1 :])), *known[k + 1, up]]

    order = []
    for t, some, part in _parts(rows, told):
        of_group, known = path(None, None, 0, int(t.rank), [], {}), {}
        order.append(some)
        for at, leaf, changed in zip(count(int(t.before)), some["leaf"], some["changed"]):
            way = path(part, t.g, 0, at, of_group, known)
            d = leaf if changed is None else changed
            for before, after in way:
                d = _h(before + d + after)
            columns["subroot"].append(t.subroot)
            columns["proof_sha256"].append(_h("".join(before + after for before, after in way)))
            columns["folded_root"].append(d)
            if proofs:
                columns["proof"].append([{"before": b, "after": a} for b, a in way])
    out = pd.concat(order)[["id", "leaf"]].reset_index(drop=True)
    return out.assign(**columns).assign(root=root)


def _upwards(scratch: Scratch, nodes: list[DataFrame], height: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Finishes trees level by level: ``nodes[k]`` (g, total, at, digest) are given at level k, and those of runs of lower ones join them.

    Returns the runs of every level (``g, up, run``) and all nodes made (with ``level``).
    """
    runs, made = [], None
    for k in range(height):
        here = nodes[k] if k < len(nodes) else None
        if made is not None:
            new = made.where(F.col("level") == k).select("g", "total", "at", "digest")
            here = new if here is None else here.unionByName(new)
        # a run is 16 nodes at most
        run = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        level = scratch.save(here.groupBy("g", "total", F.floor(F.col("at") / RUN).alias("up")).agg(run.alias("run")))
        runs.append(level)
        up = level.select("g", "total", F.lit(k + 1).alias("level"), F.col("up").alias("at"), F.sha2(F.array_join("run", "").cast("binary"), 256).alias("digest"))
        made = up if made is None else made.unionByName(up)
    return runs, made


def _needed(start: DataFrame, level: Column, at: Column, runs: list[DataFrame], height: Column, keys: Sequence[str]) -> DataFrame | None:
    """``p, level, up`` and ``run`` of the runs on the way up from a node, each once for each range and group."""
    if not runs:
        return None
    steps = F.when(level < height, F.sequence(level, height - 1)).otherwise(F.array().cast("array<int>"))
    climb = start.select("p", *keys, level.alias("_k"), at.alias("_at"), F.explode(steps).alias("level"))
    up = F.call_function("shiftright", F.col("_at"), (F.col("level") - F.col("_k") + 1) * 4)
    wanted = climb.select("p", *keys, "level", up.alias("up")).distinct()
    whole = reduce(DataFrame.unionByName, [r.select(*keys, "up", "run", F.lit(k).alias("level")) for k, r in enumerate(runs)])
    return wanted.join(whole, [*keys, "level", "up"])


def manifest(docs: DataFrame, *, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None, proofs: bool = False) -> DataFrame:
    """The hash tree of a dataset and, for every row, the proof that it belongs to it.

    A row's leaf is ``row_digest`` of ``fields``.  In each group leaves ascend by
    id; every 16 consecutive nodes (the last run: fewer) have one parent, the
    digest of theirs concatenated, until one node is left, the group's subroot.
    The subroots, by group (null first, bytewise), have a root in the same way.
    Rows ``where`` a condition holds are tested with the columns ``changed`` in
    place of their own, all others as they are.

    Returns, per row: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``
    (digest of all siblings from the leaf up, left to right), ``folded_root`` (of
    the tested leaf and the siblings), ``verified`` (whether it is the root), and
    with ``proofs`` the ``proof`` itself: for each level what stands before and
    after in the run, for ``fold``.

    Leaves are sorted into ranges; the number of a group's leaves before a range
    comes from counts of (range, group), so each range knows where its leaves
    stand and builds all runs that are complete in it.  The few nodes at its
    edges (under 32 a level) are shuffled by group, level and parent, upper
    levels are finished from them, and the runs above a range go back to it for
    the proofs.  A task holds one range of ``PER_RANGE`` rows or so, whatever the
    size of a group, and no digest passes through the driver but the root.

    Null values count as such.  A null id comes first in its group and the null
    group first of all; ids that repeat are ordered by leaf.  Repeated rows are
    leaves of their own.  Empty table: no rows.  Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    other = F.lit(None).cast("string")
    if changed:
        tested = row_digest([changed.get(c, F.col(c)) for c in fields])
        other = tested if where is None else F.when(where, tested)
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first, then bytewise
    leaves, seen = scratch.save_counted(docs.select(F.col(id_col).alias("id"), group.alias("g"), row_digest([F.col(c) for c in fields]).alias("leaf"), other.alias("changed")), n=F.count("*"))
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", proof array<struct<before: string, after: string>>" if proofs else "")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    given = [F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", verified, *(["proof"] if proofs else [])]
    if not seen["n"]:
        return spark.createDataFrame([], columns).select(*given)
    placed = ranged(scratch, leaves, [F.col("g"), F.col("id").asc_nulls_first(), F.col("leaf")], per_range=PER_RANGE)
    scratch.drop(leaves)
    rows = placed.withColumnRenamed("_p", "p")
    of_group = Window.partitionBy("g")  # a row for each range that the group reaches
    before = F.coalesce(F.sum("n").over(of_group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = scratch.save(rows.groupBy("p", "g").agg(F.count("*").alias("n")).select("p", "g", before.alias("before"), F.sum("n").over(of_group).alias("total")))

    edges = rows.groupBy("p").cogroup(segments.withColumn("kind", F.lit("segment")).groupBy("p")).applyInPandas(_boundary, "p int, g string, total long, level int, at long, digest string")
    height = lambda total: F.when(total > 1, F.length(F.hex(total - 1))).otherwise(0)  # noqa: E731  hexadecimal digits, as a run is 16 nodes
    edges, seen = scratch.save_counted(edges.withColumn("height", height(F.col("total"))), tallest=F.max(F.when(F.col("level") < F.col("height"), F.col("height"))))
    open_edges = edges.where("level < height")
    tallest = seen["tallest"] or 0
    runs, made = _upwards(scratch, [open_edges.where(F.col("level") == k).select("g", "total", "at", "digest") for k in range(tallest)], tallest)
    tops = edges.where("level = height").select("g", F.col("digest").alias("subroot"))
    if made is not None:
        tops = tops.unionByName(made.where(F.col("level") == height(F.col("total"))).select("g", F.col("digest").alias("subroot")))
    ranked, seen = scratch.save_counted(numbered(scratch, scratch.save(tops), ["g"], "rank"), n=F.count("*"))
    groups = seen["n"]
    subroots = ranked.select(F.lit("").alias("g"), F.lit(groups).cast("long").alias("total"), F.col("rank").alias("at"), F.col("subroot").alias("digest"))
    top_runs, top_made = _upwards(scratch, [subroots], _height(groups))
    root = (subroots if top_made is None else top_made.where(F.col("level") == _height(groups))).first()["digest"]

    nothing = {"level": F.lit(None).cast("int"), "up": F.lit(None).cast("long"), "run": F.lit(None).cast("array<string>")}
    told = segments.join(ranked, "g").select("p", F.lit("segment").alias("kind"), "g", "before", "total", "rank", "subroot").withColumns(nothing)
    above = [_needed(open_edges, F.col("level"), F.col("at"), runs, F.col("height"), ["g"])]
    above.append(_needed(told, F.lit(0), F.col("rank"), top_runs, F.lit(_height(groups)), []))
    for runs_of in above:
        if runs_of is not None:
            told = told.unionByName(runs_of.withColumn("kind", F.lit("run")), allowMissingColumns=True)
    told = scratch.save(told)
    scratch.keep_only(placed, told)
    made_rows = rows.groupBy("p").cogroup(told.groupBy("p")).applyInPandas(lambda a, b: _paths(a, b, root, groups, proofs), columns)
    return made_rows.select(*given)


def _value_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


_FIELDS = " || ".join(map(_value_sql, ("doc_id", "source", "lang", "n_chars")))
SQL = f"""
WITH RECURSIVE {CRC_SQL.strip()},
hashed AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256({_FIELDS} || {_value_sql("text")}) AS leaf,
         CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({_FIELDS} || {_value_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
  FROM documents CROSS JOIN crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS seat, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS rid FROM hashed),
up(g, level, seat, digest, n) AS (
  SELECT g, 0::BIGINT, seat, leaf, n FROM leaves
  UNION ALL SELECT g, level + 1, seat // {RUN}, sha256(string_agg(digest, '' ORDER BY seat)), (n + {RUN - 1}) // {RUN} FROM up WHERE n > 1 GROUP BY g, level, seat // {RUN}, n),
subroots AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS seat, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, seat, digest, n) AS (
  SELECT 0::BIGINT, seat, subroot, n FROM subroots
  UNION ALL SELECT level + 1, seat // {RUN}, sha256(string_agg(digest, '' ORDER BY seat)), (n + {RUN - 1}) // {RUN} FROM top WHERE n > 1 GROUP BY level, seat // {RUN}, n),
levels AS (SELECT DISTINCT g, level FROM up WHERE n > 1),
low AS (SELECT l.rid, v.level AS step, u.seat AS seat, u.digest, u.seat < l.seat >> (4 * v.level) AS is_before
        FROM leaves l JOIN levels v USING (g) LEFT JOIN up u ON u.g = l.g AND u.level = v.level AND u.seat // {RUN} = l.seat >> (4 * v.level + 4) AND u.seat <> l.seat >> (4 * v.level)),
high AS (SELECT l.rid, 1000 + v.level AS step, u.seat AS seat, u.digest, u.seat < s.seat >> (4 * v.level) AS is_before
         FROM leaves l JOIN subroots s USING (g) JOIN (SELECT DISTINCT level FROM top WHERE n > 1) v ON true
         LEFT JOIN top u ON u.level = v.level AND u.seat // {RUN} = s.seat >> (4 * v.level + 4) AND u.seat <> s.seat >> (4 * v.level)),
steps AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) - 1 AS k, coalesce(string_agg(digest, '' ORDER BY seat) FILTER (is_before), '') AS before,
         coalesce(string_agg(digest, '' ORDER BY seat) FILTER (NOT is_before), '') AS after
  FROM (SELECT * FROM low UNION ALL SELECT * FROM high) GROUP BY rid, step),
folds(rid, k, digest) AS (
  SELECT rid, 0::BIGINT, coalesce(changed, leaf) FROM leaves
  UNION ALL SELECT f.rid, f.k + 1, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s USING (rid, k)),
folded AS (SELECT rid, max_by(digest, k) AS folded_root FROM folds GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY rid)
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.root AS verified
FROM leaves l JOIN subroots s USING (g) JOIN folded f USING (rid) LEFT JOIN proofs p USING (rid) CROSS JOIN (SELECT digest AS root FROM top WHERE n = 1) r
"""
