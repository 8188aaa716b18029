"""N-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.shingles import Shingler, mixed
from skyquilt.operators.graph import components
from skyquilt.storage import Scratch

SLOT_BITS = (20, 28)  # slots of a filter that keeps unneeded texts from being shuffled, as a power of two: about 16 for each id, 32 MB at most
BUCKETS, PARTS = 1 << 22, 64  # counters of shingles by hash, in parts that are summed apart: 16 MB, whatever the input
BLOCK_SETS, BLOCK_TOKENS = 256, 1_000_000  # of a group that one task clusters
SIMILAR, FEW = 50, 16  # sets this similar (in percent) stand together in a group, if their own clusters are smaller than FEW


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def needed(size, percent: int):
    """Least overlap of a set of this size with any set it links to."""
    return (size * percent + 99) // 100


def linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << SLOT_BITS[1]))


class Filter:
    """Which ids a table may have: a bitmap that grows with their number, within ``SLOT_BITS``, so it can be sent to all tasks; false positives only."""

    def __init__(self, ids: DataFrame, id_col: str):
        self.size = 1 << min(max((16 * ids.count()).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
        slot = slot_of(F.col(id_col)).bitwiseAND(self.size - 1).alias("s")
        words = ids.select(slot).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
        bitmap = np.zeros(self.size // 64, dtype=np.int64)
        got = words.toPandas()
        bitmap[got["w"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
        self.shared = ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))

    def keeps(self, slots: np.ndarray) -> np.ndarray:
        slots = slots & (self.size - 1)
        return (self.shared.value[slots >> 3] >> (slots & 7)) & 1 == 1


def sketch_frames(shingler: Shingler, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text the size, a 128-bit fingerprint and a key of two least hashes of its set; and, for a task, its counts of shingles by bucket."""
    counts, held, tokens, seen = np.zeros(BUCKETS, dtype=np.uint8), [], 0, set()
    columns = ["part", "counts", "id", "n", "f1", "f2", "key"]

    def flush() -> None:
        """Add what is held; a counter stops at 255 in a task, which is frequent enough."""
        if held:
            more = np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).view(np.int64), minlength=BUCKETS)
            np.minimum(more + counts, 255, out=more)
            counts[:] = more
            held.clear()

    for frame in frames:
        rows = []
        for i, text in zip(frame["id"], frame["text"], strict=True):
            s = shingler(text)
            if len(s):
                one, two = int(signed(np.add.reduce(mixed(s)).reshape(1))[0]), int(signed(np.bitwise_xor.reduce(mixed(s + np.uint64(7))).reshape(1))[0])
                other = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).min()
                key = int(signed(np.bitwise_xor.reduce(mixed(np.array([s[0], other])) >> np.array([0, 1], dtype=np.uint64)).reshape(1))[0])
                if one not in seen:  # copies of a set count once
                    seen.add(one)
                    held.append(s)
                    tokens += len(s)
            else:
                one = two = key = 0
            rows.append((-1, None, i, len(s), one, two, key))
            if tokens > 1_000_000:
                flush()
                tokens = 0
                seen.clear()
        yield pd.DataFrame(rows, columns=columns).astype({"id": "Int64"})
    flush()
    width = BUCKETS // PARTS
    some = [(k, counts[k * width : (k + 1) * width].tobytes(), None, 0, 0, 0, 0) for k in range(PARTS) if counts[k * width : (k + 1) * width].any()]
    yield pd.DataFrame(some, columns=columns).astype({"id": "Int64"})


def sum_counts(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BUCKETS // PARTS, dtype=np.int64)
    for some in frame["counts"]:
        total += np.frombuffer(some, dtype=np.uint8)
    return pd.DataFrame({"part": frame["part"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def overlaps(s: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Members that a sorted set shares with each of several others."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
    begins = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]]).astype(np.int64)
    return np.add.reduceat((s[at] == flat).astype(np.int64), begins)


def lead_sets(sets: list[np.ndarray], among: np.ndarray, percent: int) -> np.ndarray:
    """Leaders: the first set left leads all that are similar enough to it, until none is left."""
    sizes = np.array([len(s) for s in sets])
    leader, left = np.arange(len(sets)), among
    while len(left) > 1:
        head, left = left[0], left[1:]
        fit = left[np.minimum(sizes[left], sizes[head]) * 100 >= percent * np.maximum(sizes[left], sizes[head])]
        if len(fit):
            own = fit[linked(overlaps(sets[head], [sets[i] for i in fit]), sizes[fit], sizes[head], percent)]
            leader[own] = head
            left = left[~np.isin(left, own)]
    return leader


def link_sets(sets: list[np.ndarray], root: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Joins the roots of sets that link, each of ``first`` with those of ``second`` that it is not joined to yet."""
    sizes = np.array([len(s) for s in sets])
    for i in first:
        rest = second[(root[second] != root[i]) & (np.minimum(sizes[second], sizes[i]) * 100 >= percent * np.maximum(sizes[second], sizes[i]))]
        if len(rest):
            hit = rest[linked(overlaps(sets[i], [sets[j] for j in rest]), sizes[rest], sizes[i], percent)]
            for old in np.unique(root[hit]):
                root[root == old] = root[i]
    return root


def cluster_block(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Clusters, groups and links of a block of sets.

    A cluster is a leader and all that link to it; one of many sets is a group.
    Small clusters whose leaders are similar make one group together, and their
    sets are compared here; ``root`` tells which of a group are connected.
    """
    frame = frame.drop_duplicates("id").sort_values("id", ignore_index=True)
    sets = [np.asarray(s, dtype=np.int64) for s in frame["s"]]
    leader = lead_sets(sets, np.arange(len(sets)), percent)
    many = np.bincount(leader, minlength=len(sets))[leader] >= FEW
    heads = np.flatnonzero((leader == np.arange(len(sets))) & ~many)
    above = lead_sets(sets, heads, SIMILAR)
    group, root = np.where(many, leader, above[leader]), leader.copy()
    for g in np.unique(group[~many]):
        members = np.flatnonzero((group == g) & ~many)
        root = link_sets(sets, root, members, members, percent)
    ids = frame["id"].to_numpy()
    return pd.DataFrame({"id": ids, "key": frame["key"], "leader": ids[leader], "group": ids[group], "root": ids[root], "many": many, "blocks": frame["blocks"]})


def bits_of(s: np.ndarray) -> bytes:
    """A set as a bitmap of at least two bits for each member."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bitmap = np.zeros(width, dtype=bool)
    bitmap[(s.view(np.uint64) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bitmap).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as one of ``size`` bytes at most: shingles keep their place by its last bits."""
    x = np.frombuffer(bits, dtype=np.uint8)
    return np.bitwise_or.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x


def may_link(a: list, b: list, percent: int) -> bool:
    """Whether some set of group a can link to one of group b: few enough of its bits are missing from the union of b.

    Two sets that link have at most size - needed(size) members each that the
    other lacks; a bit that is set in one bitmap and in no bitmap of the other
    group stands for a member at least that the whole group lacks.
    """
    least = min(min(len(x["bits"]) for x in a), min(len(x["bits"]) for x in b))
    union = np.bitwise_or.reduce(np.stack([folded(x["bits"], least) for x in b]), axis=0)
    return any(int(np.bitwise_count(folded(x["bits"], least) & ~union).sum()) <= x["n"] - needed(x["n"], percent) for x in a)


def open_groups(a: list, b: list, percent: int) -> list[tuple[int, int]]:
    """Links between two groups of (id, set), sets compared in full; as many as it takes to tell what is connected."""
    union = np.unique(np.concatenate([x["s"] for x in b]))
    sets = [np.asarray(x["s"]) for x in (*a, *b)]
    ids = [x["id"] for x in (*a, *b)]
    near = np.array([i for i in range(len(a)) if np.isin(sets[i], union, assume_unique=True).sum() >= needed(len(sets[i]), percent)], dtype=np.int64)
    root = link_sets(sets, np.arange(len(sets)), near, np.arange(len(a), len(sets)), percent)
    return [(ids[i], ids[r]) for i, r in enumerate(root) if i != r]


class JaccardJoin:
    """One run of the join; see ``near_components``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.shingler, self.percent = Shingler(n), percent
        self.scratch = Scratch(docs.sparkSession)

    def kept_texts(self, ids: DataFrame) -> tuple[DataFrame, Filter]:
        return self.docs.where("id is not null").withColumn("slot", slot_of(F.col("id"))), Filter(ids, "id")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (with id and f1) and the set ``s`` of each; only texts that pass the filter are turned into sets and shuffled."""
        texts, keep = self.kept_texts(wanted)
        shingler = self.shingler

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f = f[keep.keeps(f["slot"].to_numpy())]
                for at in range(0, len(f), 500):
                    part = f.iloc[at : at + 500]
                    sets = [shingler(t) for t in part["text"]]
                    f1 = [int(signed(np.add.reduce(mixed(s)).reshape(1))[0]) if len(s) else 0 for s in sets]
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "f1": f1, "s": [np.sort(signed(s)) for s in sets]})

        return texts.mapInPandas(make, "id long, f1 long, s array<long>").join(wanted, ["id", "f1"])

    def lead(self, reps: DataFrame) -> DataFrame:
        """Groups: sets of one key are clustered around leaders, in blocks of bounded size; then the leaders of large clusters of keys with several blocks, and so on.

        Returns ``id, group, root, part`` of the sets that were compared: the
        group of the first round, what it is connected to there, and the leader
        of the last round, which groups that are connected as wholes share.
        """
        percent, scratch = self.percent, self.scratch
        pool, sets, found = reps.select("id", "f1", "n", "key"), None, None
        while True:
            sizes = pool.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).where("m > 1")
            sizes = sizes.select("key", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).alias("blocks"))
            pool = pool.join(sizes, "key")
            if sets is None:
                pool = scratch.save(pool)
                sets = scratch.save(self.sets_of(pool.select("id", "f1")))
            grouped = sets.join(pool, ["id", "f1"]).withColumn("block", F.pmod(F.xxhash64("id", "blocks"), F.col("blocks")))
            led, seen = scratch.save_counted(
                grouped.groupBy("key", "block").applyInPandas(lambda f: cluster_block(f, percent), "id long, key long, leader long, group long, root long, many boolean, blocks long"),
                heads=F.count_if((F.col("blocks") > 1) & F.col("many") & (F.col("id") == F.col("leader"))),
            )
            if found is None:
                found = led.select("id", "group", "root", F.col("group").alias("part"))
            else:
                above = led.select(F.col("id").alias("part"), F.col("leader").alias("above"))
                found = found.join(above, "part", "left").select("id", "group", "root", F.coalesce("above", "part").alias("part"))
            if not seen["heads"]:
                return found
            pool = scratch.save(pool.drop("blocks").join(led.where("blocks > 1 and many and id = leader").select("id"), "id"))

    def order(self, sketches: DataFrame):
        """Counts of all shingles by bucket, in one array that every task gets."""
        summed = sketches.where("part >= 0").select("part", "counts").groupBy("part").applyInPandas(sum_counts, "part int, counts binary").collect()
        counts = np.zeros(BUCKETS, dtype=np.int32)
        for r in summed:
            counts[r["part"] * (BUCKETS // PARTS) : (r["part"] + 1) * (BUCKETS // PARTS)] = np.frombuffer(r["counts"], dtype=np.int32)
        return self.docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(self, reps: DataFrame, heavy) -> DataFrame:
        """Of each representative the rarest shingles of its set, as many as it takes to meet one of any set it links to, and its bitmap."""
        texts, keep = self.kept_texts(reps)
        shingler, percent = self.shingler, self.percent

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = heavy.value
            for f in frames:
                f = f[keep.keeps(f["slot"].to_numpy())]
                for begin in range(0, len(f), 1000):
                    part = f.iloc[begin : begin + 1000]
                    rows = []
                    for i, text in zip(part["id"], part["text"], strict=True):
                        u = shingler(text)
                        if not len(u):
                            continue
                        s = signed(u)
                        weight = counts[(u & np.uint64(BUCKETS - 1)).view(np.int64)]
                        first = np.lexsort((s, weight))[: len(s) - needed(len(s), percent) + 1]
                        rows.append((i, int(signed(np.add.reduce(mixed(u)).reshape(1))[0]), len(s), s[first], bits_of(s)))
                    yield pd.DataFrame(rows, columns=["id", "f1", "n", "prefix", "bits"])

        return texts.mapInPandas(make, "id long, f1 long, n int, prefix array<long>, bits binary")

    def across(self, members: DataFrame) -> DataFrame:
        """Links ``a, b`` between groups that no chain of groups joins yet."""
        percent, scratch = self.percent, self.scratch
        groups = scratch.save(members.groupBy("group").agg(
            F.first("part").alias("part"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("tokens"),
        ))
        # the matrix by token: each group has a token once, however many of its sets have it
        matrix = groups.select("group", F.explode("tokens").alias("token")).repartition("token")
        shared = matrix.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("token")
        cells = scratch.save(matrix.join(shared, "token").join(groups.select("group", "part", "n_min", "n_max"), "group"))
        a, b = cells.alias("a"), cells.alias("b")
        sizes_fit = (F.col("a.n_max") * 100 >= F.col("b.n_min") * percent) & (F.col("b.n_max") * 100 >= F.col("a.n_min") * percent)
        pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.group") < F.col("b.group")) & (F.col("a.part") != F.col("b.part")) & sizes_fit)
        pairs = scratch.save(pairs.select(F.col("a.group").alias("ga"), F.col("b.group").alias("gb")).distinct())

        def sides(table: DataFrame) -> DataFrame:
            one = pairs.join(table.select(F.col("group").alias("ga"), F.col("sets").alias("sa")), "ga")
            return one.join(table.select(F.col("group").alias("gb"), F.col("sets").alias("sb")), "gb")

        def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                good = [may_link(x, y, percent) and may_link(y, x, percent) for x, y in zip(f["sa"], f["sb"], strict=True)]
                yield f.loc[good, ["ga", "gb"]]

        in_pairs = pairs.select(F.col("ga").alias("group")).union(pairs.select(F.col("gb").alias("group"))).distinct()
        matrices = members.join(in_pairs, "group", "left_semi").groupBy("group").agg(F.collect_list(F.struct("n", "bits")).alias("sets"))
        pairs = scratch.save(sides(matrices).mapInPandas(bound, "ga long, gb long"))

        def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([link for x, y in zip(f["sa"], f["sb"], strict=True) for link in open_groups(list(x), list(y), percent)], columns=["a", "b"])

        in_pairs = pairs.select(F.col("ga").alias("group")).union(pairs.select(F.col("gb").alias("group"))).distinct()
        wanted = scratch.save(members.join(in_pairs, "group", "left_semi").select("id", "f1", "group"))
        sets = self.sets_of(wanted).dropDuplicates(["id", "f1"]).groupBy("group").agg(F.collect_list(F.struct("id", "s")).alias("sets"))
        return scratch.save(sides(scratch.save(sets)).mapInPandas(opened, "a long, b long"))

    def run(self) -> DataFrame:
        scratch, shingler = self.scratch, self.shingler
        sketches = scratch.save(self.docs.mapInPandas(lambda frames: sketch_frames(shingler, frames), "part int, counts binary, id long, n int, f1 long, f2 long, key long"))
        rows = sketches.where("part < 0").select("id", "n", "f1", "f2", "key")
        reps = scratch.save(rows.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.first("key").alias("key")))
        known = reps.select("id", "f1").join(self.lead(reps), "id", "left")
        known = scratch.save(known.select("id", "f1", F.coalesce("group", "id").alias("group"), F.coalesce("root", "id").alias("root"), F.coalesce("part", "id").alias("part")))
        edges = known.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(known.where("group <> part").select(F.col("group").alias("a"), F.col("part").alias("b")))
        members = scratch.save(self.prefixes(known, self.order(sketches)).join(known, ["id", "f1"]).dropDuplicates(["id", "f1"]))
        links = self.across(members)
        # rows of one id are one document, whatever their texts
        named = rows.where("n > 0 and id is not null").join(reps.select("f1", "f2", "n", F.col("id").alias("rep")), ["f1", "f2", "n"])
        named = scratch.save(named.select("id", "f1", "f2", "n", "rep"))
        same = named.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("id")
        same = named.join(same, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        whole = components(scratch, edges.union(links).union(same))
        out = named.groupBy("id", "f1", "f2", "n", "rep").agg(F.count("*").alias("copies")).join(whole, F.col("rep") == F.col("node"), "left")
        out = out.select("id", "f1", "f2", "n", F.coalesce("component", F.least("rep", "id")).alias("component"))
        out = rows.alias("r").join(out.alias("o"), F.col("r.id").eqNullSafe(F.col("o.id")) & (F.col("r.f1") == F.col("o.f1")) & (F.col("r.f2") == F.col("o.f2")) & (F.col("r.n") == F.col("o.n")), "left").select(
            F.col("r.id").alias("id"), F.col("r.n").cast("long").alias("n_shingles"), F.coalesce("component", "r.id").alias("component_id")
        )
        out = scratch.save(out)
        scratch.keep_only(out)
        return out


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents whose sets of n-word shingles have a Jaccard similarity of ``percent`` or more.

    A document's set: the distinct n-word shingles of its whole text, A-Z
    lowered; with fewer words the whole sequence as one; without words none.

    Equal sets are one node.  Similar sets, found by a key of two least hashes,
    are put into groups around leaders, in blocks of bounded size, and linked
    there.  The
    token-group matrix holds for each group the union of its sets' prefixes (the
    rarest shingles of each, as many as any linked set must share one of) and
    their bitmaps.  Groups that share a token there are compared by a bound on
    the overlap of a set with the other group's union; only pairs of groups that
    pass are opened and their sets compared in full.  Large clusters that are
    connected through their leaders are never compared again, and other similar
    sets meet as groups, so a large set of near copies costs few pairs.  No links
    are lost: keys, groups and bitmaps only save work.

    Returns, per row of ``docs``: the id (long), ``n_shingles`` and
    ``component_id``, the smallest id reachable by links, itself included.
    Null or empty text: 0 shingles, its own component.  Null id: a row with null
    component, linked with nothing.  Repeated rows: rows of their own; rows that
    share an id but not a text are one document with links of both.  Empty
    table: no rows.  Other columns are ignored.  Shingles are compared by 64-bit
    hashes, equal sets by 128 bits.
    """
    return JaccardJoin(docs, id_col, text_col, n, percent).run().withColumnRenamed("id", id_col)
