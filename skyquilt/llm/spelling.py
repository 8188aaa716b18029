"""Spelling variants: words of a corpus at edit distance one, found by a trie self-join."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.sharding import CRC_SQL, crc_sql
from skyquilt.storage import Scratch

HELD = 400_000  # distinct words that a task counts before it hands them on
MOST = 20_000  # words of one part of the trie, which one task holds


def _count(frames: Iterator[pd.DataFrame], least: int, noise: int | None) -> Iterator[pd.DataFrame]:
    """``word, n`` of the words of these texts, the same word in several rows."""
    words = re.compile("[a-zÀ-ÿ]{%d,}" % least)
    counts: Counter[str] = Counter()

    def handed() -> pd.DataFrame:
        some = [(w, n) for w, n in counts.items() if n and len(w) >= least]
        counts.clear()
        return pd.DataFrame(some, columns=["word", "n"])

    for frame in frames:
        for doc, text in zip(frame["id"], frame["text"], strict=True):
            runs = words.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes lower A-Z only
            counts.update(runs)
            if noise:
                start = zlib.crc32(f"{doc or ''}:".encode())
                hit = {run: h for run in set(runs) if (h := zlib.crc32(run.encode(), start)) % noise == 0}
                for run, n in Counter(run for run in runs if run in hit).items() if hit else ():
                    at = hit[run] % len(run)
                    counts[run] -= n
                    counts[run[:at] + run[at + 1 :]] += n
            if len(counts) > HELD:
                yield handed()
    yield handed()


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 5, seldom: int = 3, noise: int | None = None) -> DataFrame:
    """``word, n``: the words of ``least`` letters (A-Z lowered) that occur ``seldom`` times over all texts; see ``spelling_variants`` for ``noise``."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    some = texts.mapInPandas(lambda frames: _count(frames, least, noise), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seldom)


class Trie:
    """Words as paths; ``children[u]`` by letter, ``word[u]`` the word that ends at node u."""

    def __init__(self, words: list[tuple[str, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int | None] = [None]
        for path, name in words:
            u = 0
            for c in path:
                v = self.children[u].get(c)
                if v is None:
                    v = self.children[u][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                u = v
            self.word[u] = name

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Names of words at distance one, in both orders: every node hands the nodes at distance one from it (its active nodes) down to its children.

        Below node u by letter c, to u', active are: u (c is deleted) and its
        other children (c is replaced), the children of u' (a letter is inserted),
        and of each node that is active at u its child by c.
        """
        children, word = self.children, self.word
        if word[0] is not None:
            yield from ((word[0], word[v]) for v in children[0].values() if word[v] is not None)
        stack = [(0, set(children[0].values()))]
        while stack:
            u, active = stack.pop()
            around = children[u].values()
            for c, below in children[u].items():
                near = {children[v][c] for v in active if c in children[v]}
                near.update(around, children[below].values())
                near.add(u)
                near.discard(below)
                if word[below] is not None:
                    yield from ((word[below], word[v]) for v in near if word[v] is not None)
                if children[below]:
                    stack.append((below, near))


def _join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``word, n, near, near_n`` of the parts of the trie, which come one after the other, in order of ``part``."""
    rows = (row for frame in frames for row in frame[["part", "rest", "word", "n"]].itertuples(index=False))
    out: list[tuple] = []
    for _, some in groupby(rows, key=lambda row: row.part):
        some = list(some)
        if len(some) > 1:
            found = Trie([(row.rest, k) for k, row in enumerate(some)]).pairs()
            out += [(some[a].word, some[a].n, some[b].word, some[b].n) for a, b in found]
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["word", "n", "near", "near_n"])
            out = []
    yield pd.DataFrame(out, columns=["word", "n", "near", "near_n"])


def _parted(rows: DataFrame) -> DataFrame:
    """Every row (``part, most, rest, word, n``) twice, a step further down the trie of its ``rest`` and that of its mirrored ``rest``.

    Of two words of ``most`` letters at most that one edit tells apart, all but
    one letter of the longer stand before or after the edit, so they share the
    first or the last half of these; that half is the way down.
    """
    half = F.floor(F.col("most") / 2).cast("int")  # (most - 1) / 2, rounded up
    ways = F.explode(F.array(F.struct(F.lit(">").alias("way"), F.col("rest").alias("path")), F.struct(F.lit("<").alias("way"), F.reverse("rest").alias("path"))))
    return rows.withColumn("w", ways).select(
        F.concat("part", F.col("w.way"), F.substring(F.col("w.path"), F.lit(1), half)).alias("part"), (F.col("most") - half).alias("most"),
        F.substring(F.col("w.path"), half + 1, F.length("w.path")).alias("rest"), "word", "n",
    )


def near_words(scratch: Scratch, vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words that differ by exactly one inserted, deleted or replaced code point, in both orders.

    The vocabulary's trie, and that of its mirrored words, is cut into parts at
    half of the words' length, where pairs are equal up to the cut in one of the
    two.  A word of m letters is in the parts of words of m - 1 or m and of m or
    m + 1 letters.  Parts of more than ``MOST`` words are cut again at half of
    what is left, in both directions, until none is; what is left at last is one
    letter, so this ends.
    """
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1))
    rows = _parted(vocabulary.select("word", "n", lengths.alias("most")).select(F.col("most").cast("string").alias("part"), "most", F.col("word").alias("rest"), "word", "n"))
    parts, small = rows, []
    while True:
        heavy = scratch.save(parts.groupBy("part", "most").agg(F.count("*").alias("words")).where((F.col("words") > MOST) & (F.col("most") > 1)).select("part"))
        if heavy.isEmpty():
            break
        parts = scratch.save(parts)
        small.append(parts.join(heavy, "part", "left_anti"))
        parts = _parted(parts.join(heavy, "part", "left_semi"))
    for some in small:
        parts = parts.unionByName(some)
    found = parts.repartition("part").sortWithinPartitions("part").mapInPandas(_join, "word string, n long, near string, near_n long")
    return found.distinct()  # an edit in the middle is found from both sides


def roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``word, root`` (and ``moved``), a table of ``scratch``: the last word of each chain of ``word, form``, by doubling the length of the known ways."""
    now = scratch.save(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer, seen = scratch.save_counted(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), moved=F.count_if("moved"))
        scratch.drop(now)
        now = longer
        if not seen["moved"]:
            return now


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 5, seldom: int = 3, times: int = 2, noise: int | None = None) -> DataFrame:
    """Groups the words of a corpus by spelling.

    Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z
    lowered, of ``least`` code points, that occur ``seldom`` times over all texts.
    Two are near if they differ by one inserted, deleted or replaced code point.
    A word's form is its near word of largest count (ties: the first in
    code-point order), if that is at least ``times`` its own count.  With
    ``noise``, misspellings are put in first: where it divides the crc32 of
    ``<id>:<run>``, the run loses the code point at crc32 % length.

    Returns a row per word: ``word, form, root`` (the end of the chain of forms,
    the word itself without one), ``n``, ``n_near`` and ``form_n``.

    Null and empty texts have no words, repeated rows count each, a null id counts
    as an empty one, other columns are ignored; an empty table gives no rows.
    Texts are read once; counts are summed in each task before they are shuffled.
    No word has more near ones than its letters allow, so no list is unbounded,
    and parts of the trie that are too large for a task are cut (``near_words``).
    """
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.save(count_words(docs, id_col=id_col, text_col=text_col, least=least, seldom=seldom, noise=noise))
    near = near_words(scratch, vocabulary)
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    judged = near.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best)
    form: Column = F.when(-F.col("best.rank") >= times * F.col("n"), F.col("best.near"))
    judged = scratch.save(judged.select("word", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("best.rank")).alias("form_n")))
    rooted = roots(scratch, judged.where("form is not null"))
    scratch.keep_only(vocabulary, judged, rooted)
    return (
        vocabulary.join(judged, "word", "left").join(rooted, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


SQL = f"""
WITH RECURSIVE {CRC_SQL.strip()},
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents)),
each AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run),
summed AS (SELECT run, c, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM each CROSS JOIN crc_table),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (SELECT word, n, length(word) AS len, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM cuts a JOIN words w ON a.cut = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM cuts a JOIN words w ON a.cut = w.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS rk FROM pairs),
judged AS (SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM ranked WHERE rk = 1),
chain(word, at_, k) AS (SELECT word, word, 0 FROM words UNION ALL SELECT c.word, j.form, k + 1 FROM chain c JOIN judged j ON j.word = c.at_ WHERE j.form IS NOT NULL),
ends AS (SELECT word, max_by(at_, k) AS root FROM chain GROUP BY word)
SELECT w.word, j.form, e.root, w.n, coalesce(j.n_near, 0) AS n_near, j.form_n FROM words w JOIN ends e USING (word) LEFT JOIN judged j USING (word)
"""
