"""Embedding near-duplicates by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.operators.graph import components
from skyquilt.storage import Scratch

QUERY_BLOCK, INDEX_BLOCK = 4096, 1024  # vectors of a cell that are compared at a time
REGION_BYTES, REGION_ROWS = 8 << 20, 1 << 15  # vectors of a region's list in one task, as doubles; of its visitors four times as many


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_of(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None, :]


def nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[at : at + 2048], centres).argmin(axis=1) for at in range(0, len(x), 2048)])


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length, as rows."""
    return lists.flatten().to_numpy().reshape(len(lists), -1) if isinstance(lists, pa.Array) else np.concatenate([matrix(c) for c in lists.chunks if len(c)])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def region_rows(width: int) -> int:
    """Vectors of a region's list that one task holds."""
    return int(np.clip(REGION_BYTES // (8 * width), 1, REGION_ROWS))


class MultiIndex:
    """A codebook for each half of the vectors; the pairs of codewords are the cells of a grid.

    Codewords near each other form groups, and the cells of two groups a region:
    a vector is sent once to each region that it visits, and not to each cell.
    """

    def __init__(self, sample: np.ndarray, rows: int, *, cosine: float, recall: float, per_cell: int = 16, rounds: int = 12, seed: int = 7):
        """Codebooks for ``rows`` vectors: about ``per_cell`` vectors a cell; a codeword has four vectors of the sample at least."""
        rng = np.random.default_rng(seed)
        self.half = max(1, sample.shape[1] // 2)
        k = int(np.clip(2 ** round(np.log2(max(1.0, (rows / per_cell) ** 0.5))), 1, max(1, len(sample) // 4)))
        self.books = [kmeans(sample[:, : self.half], k, rounds, rng), kmeans(sample[:, self.half :], k, rounds, rng)]
        self.visits = self._calibrate(sample, cosine, recall, rng)
        groups = max(1, round((rows / region_rows(sample.shape[1])) ** 0.5))
        self.groups = [nearest_of(book, kmeans(book, groups, rounds, rng)) for book in self.books]

    def regions(self, cells: np.ndarray) -> np.ndarray:
        first, second = np.divmod(cells, len(self.books[1]))
        return self.groups[0][first] * len(self.books[1]) + self.groups[1][second]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [squared(x[:, : self.half], self.books[0]), squared(x[:, self.half :], self.books[1])]

    def own(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def _calibrate(self, sample: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> int:
        """Cells to visit so that ``recall`` of the partners at the least similarity, in random directions, lie in them."""
        x = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
        off = rng.normal(size=x.shape)
        off -= (off * x).sum(axis=1)[:, None] * x
        off /= np.maximum(np.linalg.norm(off, axis=1), 1e-12)[:, None]
        partner = self.own(cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * off)
        ranks = []
        a, b = self.distances(x)
        for da, db, cell in zip(a, b, partner, strict=True):  # cells nearer than the partner's, counted codeword by codeword
            goal = da[cell // len(db)] + db[cell % len(db)]
            ranks.append(np.searchsorted(np.sort(db), goal - da).sum())
        return int(np.quantile(ranks, recall, method="higher")) + 1

    def nearest_cells(self, x: np.ndarray) -> np.ndarray:
        """The ``visits`` nearest cells of each vector, nearest first, by multi-sequence traversal.

        A cell of the i-th nearest codeword of one half and the j-th of the other
        has (i + 1)(j + 1) - 1 cells at least as near, so only pairs with
        (i + 1)(j + 1) <= visits can be among the first.
        """
        a, b = self.distances(x)
        pa, pb = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        pairs = np.array([(i, j) for i in range(min(self.visits, a.shape[1])) for j in range(min(self.visits // (i + 1), b.shape[1]))])
        rows = np.arange(len(x))[:, None]
        ca, cb = pa[rows, pairs[:, 0]], pb[rows, pairs[:, 1]]
        first = np.argsort(a[rows, ca] + b[rows, cb], axis=1, kind="stable")[:, : self.visits]
        return (ca * b.shape[1] + cb)[rows, first]


def stops(index: MultiIndex, x: np.ndarray) -> pa.Array:
    """The regions that each vector visits, with its cells there."""
    cells = index.nearest_cells(x)
    regions = index.regions(cells)
    order = np.argsort(regions, axis=1, kind="stable")
    cells, regions = (np.take_along_axis(a, order, axis=1) for a in (cells, regions))
    starts = np.ones(cells.shape, dtype=bool)
    starts[:, 1:] = regions[:, 1:] != regions[:, :-1]
    runs = np.append(np.flatnonzero(starts.ravel()), cells.size).astype(np.int32)
    ends = np.append(0, np.cumsum(starts.sum(axis=1))).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(runs), pa.array(cells.ravel()))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(regions[starts]), listed], names=["region", "cells"]))


def compare(x: np.ndarray, qi: np.ndarray, q_mult: np.ndarray, home: np.ndarray, y: np.ndarray, ii: np.ndarray, i_mult: np.ndarray, visits: np.ndarray, cosine: float) -> np.ndarray | None:
    """Links between vectors that visit a cell and those in it: rows of node, number of links and smallest node they lead to.

    A link is counted for the visitor.  It is counted for the other end too
    unless that one visits the visitor's cell, where it counts for itself.
    """
    hits = x @ y.T >= cosine
    hits &= qi[:, None] != ii[None, :]
    rows, cols = hits.any(axis=1), hits.any(axis=0)
    if not rows.any():
        return None
    hits, qi, ii, q_mult, home, visits = hits[rows][:, cols], qi[rows], ii[cols], q_mult[rows], home[rows], visits[cols]
    of_query = hits @ i_mult[cols]
    alone = np.zeros(len(ii), dtype=np.int64)
    for cell in np.unique(home):
        here = home == cell
        alone += np.where((visits == cell).any(axis=1), 0, q_mult[here] @ hits[here])
    # connected parts of this comparison, by smallest node
    big = np.iinfo(np.int64).max
    root_q, root_i = qi.copy(), ii.copy()
    while True:
        before = np.concatenate([root_q, root_i])
        root_q = np.minimum(root_q, np.where(hits, root_i[None, :], big).min(axis=1))
        root_i = np.minimum(root_i, np.where(hits, root_q[:, None], big).min(axis=0))
        if (np.concatenate([root_q, root_i]) == before).all():
            break
    return np.stack([np.concatenate([qi, ii]), np.concatenate([of_query, alone]), np.concatenate([root_q, root_i])])


def compare_region(queries: pa.Table, index: pa.Table, cosine: float) -> pa.Table:
    """Links between visitors of a region and its vectors, cell by cell: one row for each vector that has any."""
    found: list[np.ndarray] = []
    if len(queries) and len(index):
        x, y = unit(matrix(queries["v"])), unit(matrix(index["v"]))
        qi, q_mult, home = (queries[c].to_numpy() for c in ("node", "mult", "home"))
        ii, i_mult, cell_of, visits = *(index[c].to_numpy() for c in ("node", "mult", "home")), matrix(index["visits"])
        asked = np.concatenate([c.flatten().to_numpy() for c in queries["cells"].chunks])
        who = np.repeat(np.arange(len(qi)), np.concatenate([c.value_lengths().to_numpy() for c in queries["cells"].chunks]))
        by_cell, listed = np.argsort(asked, kind="stable"), np.argsort(cell_of, kind="stable")
        asked, who, cell_of = asked[by_cell], who[by_cell], cell_of[listed]
        for cell in np.unique(cell_of):
            visitors, members = (a[slice(*np.searchsorted(key, [cell, cell + 1]))] for key, a in ((asked, who), (cell_of, listed)))
            for q in (visitors[at : at + QUERY_BLOCK] for at in range(0, len(visitors), QUERY_BLOCK)):
                for i in (members[at : at + INDEX_BLOCK] for at in range(0, len(members), INDEX_BLOCK)):
                    met = compare(x[q], qi[q], q_mult[q], home[q], y[i], ii[i], i_mult[i], visits[i], cosine)
                    if met is not None:
                        found.append(met)
    node, links, root = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    ids, at = np.unique(np.concatenate([node, root]), return_inverse=True)
    a, b = at[: len(node)], at[len(node) :]
    total, part = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    np.add.at(total, a, links)
    while True:  # parts of all comparisons together; ids are in order, so the smallest place is the smallest node
        low = np.minimum(part[a], part[b])
        after = part.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == part).all():
            return pa.table({"node": ids, "links": total, "root": ids[part]})
        part = after


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.97, max_sample: int = 20_000) -> DataFrame:
    """Links between vectors of cosine similarity ``cosine`` or more, and their components.

    Both halves of the vectors get a codebook (k-means on at most ``max_sample``
    vectors, chosen by a hash); every vector is listed in the cell of its two
    codewords.  Every vector then visits its nearest cells, as many as it takes
    to find ``recall`` of the partners at the least similarity from one end (a
    link can be found from either end, so more are found), and is compared in
    double precision with all vectors in them.

    Returns, per row: the id, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable, itself included) and ``kept``
    (id = component_id).  Links found are right; a few may be missed.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing.  Vectors of different lengths do not link; each length has
    an index of its own.  Null id: null component, links with nothing, kept
    false.  Equal vectors are one node and count with their number, so repeated
    rows are vectors of their own, linked with each other.  Rows that share an id
    but not the vector are told apart by the vector.  Empty table: no rows.
    Other columns are ignored.

    Near cells form regions of about ``region_rows`` vectors, and a vector goes
    once to each region that it visits.  Visitors and lists of a region are dealt
    in blocks of bounded size, so one cell with a third of all vectors is many
    tasks; a task returns a row for each vector that has links there and never
    the pairs.
    """
    scratch = Scratch(vectors.sparkSession)
    narrow = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if narrow else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.select("id", F.when(F.col("fine"), F.xxhash64(F.xxhash64("v"), F.xxhash64(F.reverse("v")))).alias("node"), F.when(F.col("fine"), F.size("v")).alias("width"), "v")
    # a copy's vector is only needed once, so only numbers are gathered
    nodes = rows.where("node is not null").groupBy("node", "width").agg(F.min("id").alias("id"), F.count("*").alias("mult"))
    firsts = rows.where("node is not null").select("node", "id", "v").join(nodes, ["node", "id"]).dropDuplicates(["node"])
    nodes = scratch.save(firsts.select("node", "width", "id", "mult", "v"))
    widths = [(r["width"], r["count"]) for r in nodes.groupBy("width").count().orderBy("width").collect()]
    if not widths:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    met = reduce(DataFrame.union, [_links(scratch, nodes.where(F.col("width") == w), n, w, kind, cosine=cosine, recall=recall, max_sample=max_sample) for w, n in widths])
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(scratch, met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = scratch.save(nodes.select("node", "id", "mult").join(links, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")))
    least = grouped.groupBy("part").agg(F.min("id").alias("component_id"))
    known = grouped.join(least, "part").select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    known = scratch.save(known)
    scratch.keep_only(known)
    out = rows.select("id", "node").join(known, "node", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _links(scratch: Scratch, nodes: DataFrame, count: int, width: int, kind: str, *, cosine: float, recall: float, max_sample: int) -> DataFrame:
    """``node, links, root`` of the nodes of one length, a row for each task in which a node has links."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(max_sample).select("v").toArrow()
    index = MultiIndex(unit(matrix(sample["v"])), count, cosine=cosine, recall=recall)
    shared = nodes.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, len(batch), 1000)):
                x = unit(matrix(part["v"]))
                home = shared.value.own(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(shared.value.regions(home)), stops(shared.value, x)], names=["node", "mult", "v", "home", "region", "stops"])

    placed = scratch.save(nodes.select("node", "mult", "v").mapInArrow(place, f"node long, mult long, v {kind}, home long, region long, stops array<struct<region:long,cells:array<long>>>"))
    per = region_rows(width)
    asked = placed.select(F.explode("stops.region").alias("region")).groupBy("region").agg(F.ceil(F.count("*") / (4 * per)).alias("q_blocks"))
    listed = placed.groupBy("region").agg(F.ceil(F.count("*") / per).alias("i_blocks"))
    blocks = scratch.save(asked.join(listed, "region"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = placed.select("node", "mult", "v", "home", F.explode("stops").alias("stop")).select("node", "mult", "v", "home", "stop.*")
    queries = queries.join(blocks, "region").withColumn("qb", F.pmod(F.xxhash64("node"), "q_blocks")).withColumn("ib", spread("i_blocks"))
    listing = placed.select("node", "mult", "v", "home", "region", F.flatten("stops.cells").alias("visits"))
    listing = listing.join(blocks, "region").withColumn("ib", F.pmod(F.xxhash64("node", F.lit(1)), "i_blocks")).withColumn("qb", spread("q_blocks"))
    keys = ["region", "qb", "ib"]
    # under new names, as both sides come from one table
    queries = queries.select(*[F.col(c).alias(c) for c in (*keys, "node", "mult", "v", "home", "cells")])
    listing = listing.select(*[F.col(c).alias(c) for c in (*keys, "node", "mult", "v", "home", "visits")])
    met = queries.groupBy(*keys).cogroup(listing.groupBy(*keys)).applyInArrow(lambda q, i: compare_region(q, i, cosine), "node long, links long, root long")
    return scratch.save(met)
