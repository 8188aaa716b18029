"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.storage import Scratch

SPACES = r"[\x20\x09\x0B-\x0D]+"  # between words of a line
LONG = 64  # sets of more words have parities of 128 bits
KEYS = 4  # of a set's rarest words, so many in pairs find its near copies
CROWD = 8  # pairs of words in fewer sets are left to the join by single words, which then tries a few pairs of sets more
STEPS = 4  # levels of rarity for each doubling of a word's count
SHARED = 2 << 55  # codes below are of words that stand in one line only: nothing else falls into their bucket
PASSES = 2  # shares of the words in which the last join is done
RANK_BITS, SLOT_BITS = (15, 21), (16, 28)  # sizes of the rarity table and of the filters grow with their input between these powers of two


def _power(n: float, bits: tuple[int, int]) -> int:
    """The power of two, within bounds, for about n."""
    return min(max(math.ceil(math.log2(max(n, 1))), bits[0]), bits[1])


def _packed(words: DataFrame, size: int) -> Column:
    """``size`` longs, of which ``words`` (w, bits) has some, as one array that every task reads: a scalar subquery, put together in two steps."""
    every = words.sparkSession.range(size).select(F.col("id").alias("w")).join(words, "w", "left").select("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    parts = every.groupBy(F.shiftright("w", 10).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("some"))
    return parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "some"))), lambda x: x["some"])).alias("all")).scalar()


def _filter(sigs: DataFrame, count: int, col: str | Column = "sig") -> Column:
    """Whether ``col`` may be among ``sigs``: a bitmap of about 16 bits for each, within SLOT_BITS; with false positives only."""
    size = 1 << _power(16 * count, SLOT_BITS)
    words = sigs.select(F.col("sig").bitwiseAND(size - 1).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    sig = F.col(col) if isinstance(col, str) else col
    word = F.get(_packed(words, size >> 6), F.shiftright(sig.bitwiseAND(size - 1), 6).cast("int"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), sig.bitwiseAND(63).cast("int")).bitwiseAND(word) != 0


def _words(line: Column) -> Column:
    """The distinct words of a line, hashed."""
    return F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))


def _coded(lines: DataFrame, size: int) -> DataFrame:
    """``lines`` with the ``codes`` of their distinct words, sorted by a global order: how often a word's hash bucket occurs over all lines, in ``STEPS`` a doubling, before 55 bits of its hash.

    ``size`` is the number of buckets.  The order decides how much is compared
    and never what is found.
    """
    counts = lines.select(F.explode(F.split("words", " ")).alias("w")).groupBy(F.xxhash64("w").bitwiseAND(size - 1).alias("b")).count()
    level = F.least(F.floor(F.log2("count") * STEPS) + 1, F.lit(255)).cast("long")
    words = counts.select(F.col("b").alias("w"), F.shiftleft(level, 55).alias("bits"))

    def code(t: Column, levels: Column) -> Column:
        return F.get(levels, t.bitwiseAND(size - 1).cast("int")).bitwiseOR(F.shiftrightunsigned(t, 9))

    # a lambda holds no subquery, so it is a column that the optimizer puts in where it is used: once, as an argument, by reference
    tabled = lines.withColumn("levels", _packed(words, size))
    codes = F.transform(F.array("levels"), lambda levels: F.transform(F.transform(F.split("words", " "), lambda w: F.xxhash64(w)), lambda t: code(t, levels)))[0]
    return tabled.withColumn("codes", F.sort_array(F.array_distinct(codes))).drop("levels")


def _keys() -> Column:
    return F.struct("id", "th", "line")


class LineDedup:
    """The join on one table; see ``repeated_lines`` and ``drop_repeated_lines``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, fifths: int):
        self.docs, self.id_col, self.text_col, self.fifths = docs, id_col, text_col, fifths
        self.scratch = Scratch(docs.sparkSession)

    def least(self, n: Column, share: int, of: int) -> Column:
        """n * share / of, rounded up."""
        return F.floor((n * share + of - 1) / of).cast("int")

    def split(self) -> tuple[DataFrame, int]:
        """Every line with a word: id, hash of the text, number, and the line lowered, with one space between words; and the characters of all."""
        text, low = F.col(self.text_col), F.col("low")
        docs = self.docs.select(F.col(self.id_col).alias("id"), F.xxhash64(text).alias("th"), F.lower(text).alias("low"))
        odd = functools.reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in ("  ", "\t", "\x0b", "\f", "\r")])
        lines = docs.select("id", "th", F.posexplode(F.split(F.when(odd, F.regexp_replace(low, SPACES, " ")).otherwise(low), "\n", -1)).alias("line", "words"))
        lines = lines.select("id", "th", "line", F.trim("words").alias("words")).where("words <> ''")
        lines, seen = self.scratch.save_counted(lines, "zstd", size=F.sum(F.length("words")))
        return lines, seen["size"] or 0

    def marked(self, lines: DataFrame, size: int) -> DataFrame:
        """Every line with the number of its distinct words, a fingerprint of the set, the codes of its rarest words (as many as it takes to meet one of any set it matches), and a parity: each word flips one of 64 bits, or of 128 where the set is ``LONG``."""
        place = lambda t: t.bitwiseAND(63).cast("int")
        folded = F.aggregate("codes", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(t))))
        upper = F.aggregate("codes", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.shiftright(t, 6).bitwiseAND(1), place(t))))
        coded = _coded(lines, 1 << _power(size / 4096, RANK_BITS)).select("id", "th", "line", "codes")
        prefix = F.slice("codes", F.lit(1), F.size("codes") - self.least(F.size("codes"), self.fifths, 5) + 1)
        coded = coded.select("*", F.size("codes").alias("n"), F.when(F.size("codes") > LONG, upper).otherwise(0).alias("upper"))
        return self.scratch.save(coded.select("id", "th", "line", "n", F.xxhash64("codes").alias("sig"), folded.bitwiseXOR(F.col("upper")).alias("parity"), "upper", prefix.alias("prefix")))

    def sets(self, marked: DataFrame) -> DataFrame:
        """The distinct sets, numbered (``rk``) in the order in which they first stand in the corpus."""
        sets = marked.groupBy("sig").agg(F.min(_keys()).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "parity", "upper", "prefix")])
        return self.scratch.save(sets.orderBy("first").withColumn("rk", F.monotonically_increasing_id()), "zstd")

    def fits(self, a: str, b: str) -> Column:
        """Whether sets of these sizes and parities can match: they differ in ``apart`` words at most, and each bit that differs is a word that does."""
        n, m, f = F.col(f"{a}.n"), F.col(f"{b}.n"), self.fifths
        lower, upper = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("parity", "upper"))
        bits = F.when((n > LONG) & (m > LONG), F.bit_count(lower) + F.bit_count(upper)).otherwise(F.bit_count(lower.bitwiseXOR(upper)))
        return (n * 5 >= m * f) & (m * 5 >= n * f) & (bits <= self.apart(a, b))

    def apart(self, a: str, b: str) -> Column:
        return F.floor((F.col(f"{a}.n") + F.col(f"{b}.n")) * (5 - self.fifths) / (5 + self.fifths))

    def placed(self, a: str, b: str) -> Column:
        """Whether a word shared at these places can be the first one shared: what stands before it, and what one has more behind it, is not shared."""
        at, other = F.col(f"{a}.at"), F.col(f"{b}.at")
        return at + other + F.abs((F.col(f"{a}.n") - at) - (F.col(f"{b}.n") - other)) <= self.apart(a, b)

    def early(self) -> Column:
        """Whether a word can be the first one shared with a set of the same size or a larger one: the smaller set has that among fewer of its rarest words than the larger one."""
        return F.col("at") <= F.col("n") - self.least(F.col("n"), 2 * self.fifths, 5 + self.fifths)

    @staticmethod
    def postings(sets: DataFrame, *more: str) -> DataFrame:
        """The sets by their rarest words, but for words that stand in one line only."""
        return sets.select("rk", "n", "parity", "upper", *more, F.posexplode("prefix").alias("at", "code")).where(F.col("code") >= SHARED)

    @staticmethod
    def keyed(sets: DataFrame) -> DataFrame:
        """The sets by pairs of their rarest words: of those that other lines may have, the ``KEYS`` first by hash, so that near copies mostly have a pair in common and other sets hardly ever; where there are fewer than three, by single words too."""
        own = F.transform(F.filter("prefix", lambda c: c >= SHARED), lambda c: c.bitwiseAND((1 << 55) - 1))
        sets = sets.select("rk", "n", "parity", "upper", F.slice(F.sort_array(own), 1, KEYS).alias("own"))
        word, several = lambda i: F.get("own", F.lit(i)), F.size("own")
        keys = [F.when(several > j, F.xxhash64(word(i), word(j))) for i, j in itertools.combinations(range(KEYS), 2)]
        keys += [F.when((several > i) & (several < 3), F.xxhash64(word(i))) for i in range(2)]
        return sets.select("rk", "n", "parity", "upper", F.explode(F.array(*keys)).alias("key")).where("key is not null")

    @staticmethod
    def among(found: DataFrame, count: int) -> Column:
        """Whether ``rk`` may be among those of ``found``."""
        return _filter(found.select(F.xxhash64("rk").alias("sig")), count, F.xxhash64("rk"))

    def verified(self, lines: DataFrame, sets: DataFrame, tries: DataFrame) -> DataFrame:
        """``rk, near``: of the pairs ``later, earlier`` whose sets are similar enough, counted in full, the earliest of each ``later``."""
        ends = tries.select(F.col("later").alias("rk")).union(tries.select(F.col("earlier").alias("rk"))).distinct()
        wanted, seen = self.scratch.save_counted(sets.select("rk", F.xxhash64("first.id", "first.th", "first.line").alias("sig"), "first.*").join(ends, "rk"), n=F.count("*"))
        own = lines.withColumn("sig", F.xxhash64("id", "th", "line")).where(_filter(wanted.select("sig"), seen["n"])).select("sig", "words")
        # repeated rows have a line several times
        toks = self.scratch.save(own.groupBy("sig").agg(F.min("words").alias("words")).join(wanted, "sig").select("rk", _words(F.col("words")).alias("toks")))
        both = tries.join(toks.select(F.col("rk").alias("later"), F.col("toks").alias("ta")), "later").join(toks.select(F.col("rk").alias("earlier"), F.col("toks").alias("tb")), "earlier")
        shared = F.size(F.array_intersect("ta", "tb"))
        good = both.where(shared * 5 >= (F.size("ta") + F.size("tb") - shared) * self.fifths)
        found = self.scratch.save(good.groupBy(F.col("later").alias("rk")).agg(F.min("earlier").alias("near")))
        self.scratch.drop(toks, wanted)
        return found

    def matches(self, lines: DataFrame, sets: DataFrame) -> DataFrame:
        """``rk, near``: the sets that match an earlier one, and the earliest of these.

        First each set of a crowd is compared with one other: of the sets that stand
        first in the long lists of its keys, the earliest that fits.  In a large group
        of near copies that is mostly the earliest of the group.  Then all sets are
        joined by their words with those before them, and before the match where
        there is one.
        """
        scratch = self.scratch
        lists, seen = scratch.save_counted(self.keyed(sets).groupBy("key").agg(F.min("rk").alias("rk"), F.count("*").alias("n")).where(F.col("n") >= CROWD).select("key", "rk"), n=F.count("*"))
        own = self.keyed(sets).where(_filter(lists.select(F.col("key").alias("sig")), seen["n"], "key")).alias("a")
        head = lists.join(sets.select("rk", "n", "parity", "upper"), "rk").alias("b")
        heads = own.join(head, (F.col("a.key") == F.col("b.key")) & (F.col("b.rk") < F.col("a.rk")) & self.fits("a", "b"))
        tries, seen = scratch.save_counted(heads.groupBy(F.col("a.rk").alias("later")).agg(F.min("b.rk").alias("earlier")), n=F.count("*"))
        found = self.verified(lines, sets, tries)
        slim, matched = sets.select("rk", "n", "parity", "upper", "prefix"), self.among(found, seen["n"])
        bounded = scratch.save(slim.where(matched).join(found, "rk", "left").withColumn("bound", F.coalesce("near", "rk")).drop("near"))
        open_ = slim.where(~matched).withColumn("bound", F.col("rk")).unionByName(bounded)
        scratch.drop(lists, tries)
        pairs = None
        for k in range(PASSES):  # a share of the words at a time, so that fewer postings are on disk at once
            share = F.pmod("code", F.lit(PASSES)) == k
            b = self.postings(open_, "bound").where(share)
            a, b = b.where(self.early()).alias("a"), b.alias("b")
            before = (F.col("a.rk") < F.col("b.bound")) | (F.col("b.rk") < F.col("a.bound"))
            some = a.join(b, (F.col("a.code") == F.col("b.code")) & (F.col("a.n") <= F.col("b.n")) & before & self.fits("a", "b") & self.placed("a", "b"))
            some = scratch.save(some.select(F.greatest("a.rk", "b.rk").alias("later"), F.least("a.rk", "b.rk").alias("earlier")).distinct())
            pairs = some if pairs is None else pairs.union(some)
        scratch.drop(bounded)
        more = self.verified(lines, sets, scratch.save(pairs.distinct()))
        return found.union(more).groupBy("rk").agg(F.min("near").alias("near"))

    def removed(self) -> DataFrame:
        """Lines that match an earlier one: ``id, th, line, n, first`` with the earliest line matched."""
        lines, size = self.split()
        marked = self.marked(lines, size)
        sets = self.sets(marked)
        slim = self.scratch.save(marked.select("id", "th", "line", "n", "sig"))
        self.scratch.drop(marked)
        near, seen = self.scratch.save_counted(self.matches(lines, sets), n=F.count("*"))
        some = sets.select("rk", "sig", "first", "copies").where((F.col("copies") > 1) | self.among(near, seen["n"])).join(near, "rk", "left")
        before = sets.where(self.among(near.select(F.col("near").alias("rk")), seen["n"])).select(F.col("rk").alias("near"), F.col("first").alias("before"))
        some = some.join(before, "near", "left").where("copies > 1 or before is not null").select("sig", F.coalesce("before", "first").alias("first"))
        best, seen = self.scratch.save_counted(some, n=F.count("*"))
        found = self.scratch.save(slim.where(_filter(best, seen["n"])).join(best, "sig").where(F.col("first") < _keys()).select("id", "th", "line", "n", "first"))
        self.scratch.keep_only(found)
        return found


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fifths: int = 4) -> DataFrame:
    """Lines of all texts that match an earlier line.

    A line (between line feeds) is the set of its distinct words, lowered, parted
    by ASCII white space.  Lines match at a Jaccard similarity of ``fifths`` / 5
    or more.  Earlier: of a smaller id, or further up in the text.  A line with
    several earlier matches is reported once.

    Distinct sets are joined exactly.  Words are ordered by rarity; two sets that
    match share one of their rarest words (prefix filter), stand close enough
    there (positional filter) and are of similar size (length filter); the parity
    of their words rules out most of the rest, and the similarity of what is left
    is counted.

    Returns the id, ``line_no`` (from 0), ``n_words`` (distinct), ``first_id``
    and ``first_line`` (the earliest line that matches).  Null and empty texts
    and lines without words match nothing.  A null id comes before all others.
    Rows that share an id are ordered by a hash of their texts; rows alike in
    both are one document and get the same result.  Empty table: no rows.  Other
    columns are ignored.  Words are compared by 64-bit hashes, equal sets by 64
    bits more.
    """
    found = LineDedup(docs, id_col, text_col, fifths).removed()
    return found.select(F.col("id").alias(id_col), F.col("line").alias("line_no"), F.col("n").alias("n_words"), F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fifths: int = 4) -> DataFrame:
    """The rows of ``docs``, with all their columns, without the lines that ``repeated_lines`` finds in ``text_col``.

    A text of which no line is left is empty.  Only the numbers of removed lines
    are gathered, by document.
    """
    found = LineDedup(docs, id_col, text_col, fifths).removed().groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("line").alias("_gone"))
    text = F.col(text_col)
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), text).otherwise(left)).drop("_id", "_th", "_gone")


SQL = """
WITH lines AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+'))) AS toks
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)),
kept AS (SELECT doc_id, line_no, toks, len(toks) AS n FROM lines WHERE len(toks) > 0),
classes AS (SELECT toks, n, min(struct_pack(d := doc_id, l := line_no)) AS first, row_number() OVER (ORDER BY toks) AS c FROM kept GROUP BY toks, n),
words AS (SELECT c, n, first, unnest(toks) AS w FROM classes),
freq AS (SELECT w, count(*) AS df FROM words GROUP BY w),
placed AS (SELECT c, n, first, w, row_number() OVER (PARTITION BY c ORDER BY df, w) AS spot FROM words JOIN freq USING (w)),
prefix AS (SELECT c, n, first, w FROM placed WHERE spot <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT a.c AS ca, b.c AS cb FROM prefix a JOIN prefix b ON a.w = b.w AND a.c <> b.c AND b.first < a.first AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
near AS (
  SELECT p.ca AS c, min(b.first) AS first FROM pairs p JOIN classes a ON p.ca = a.c JOIN classes b ON p.cb = b.c
  WHERE len(list_intersect(a.toks, b.toks)) * 5 >= (a.n + b.n - len(list_intersect(a.toks, b.toks))) * 4 GROUP BY p.ca),
best AS (SELECT k.toks, least(k.first, coalesce(r.first, k.first)) AS first FROM classes k LEFT JOIN near r USING (c))
SELECT l.doc_id, CAST(l.line_no AS INTEGER) AS line_no, CAST(l.n AS INTEGER) AS n_words, b.first.d AS first_id, CAST(b.first.l AS INTEGER) AS first_line
FROM kept l JOIN best b USING (toks) WHERE b.first < struct_pack(d := l.doc_id, l := l.line_no)
"""
