"""Benchmark decontamination: pigeonhole pieces and bit-parallel edit distance over words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
# Scripts written without spaces: of each character a word.  Of Thai and its neighbours four, of the others two count as a word of a spaced script.
SYLLABIC = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
UNSPACED = re.compile(f"[{SYLLABIC}\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
FEW_SYLLABLES = re.compile(f"[{SYLLABIC}]")
ANCHOR = 3  # words of a piece that are hashed; the rest is compared
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return WORD.findall(text if text.isascii() or not UNSPACED.search(text) else UNSPACED.sub(r" \g<0> ", text))


def volume_of(words: list[str]) -> tuple[float, int]:
    """What the words count as: in words of a spaced script, and in characters."""
    number, characters = 0.0, 0
    for w in words:
        if len(w) == 1 and UNSPACED.match(w):
            thai = bool(FEW_SYLLABLES.match(w))
            number += 0.25 if thai else 0.5
            characters += 1 if thai else 2
        else:
            number += 1
            characters += len(w)
    return number, characters


def best_match(masks: dict[int, int], length: int, text: np.ndarray) -> tuple[int, int]:
    """Myers: least edit distance of the whole pattern to any stretch of ``text``, and where the first such stretch ends.

    masks: for each word the pattern's places as bits.  Python's integers are the
    bit vectors, so the pattern may have any length.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, distance = full, 0, length
    best, end = length, 0
    for i, word in enumerate(text.tolist()):
        eq = masks.get(word, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if distance < best:
            best, end = distance, i + 1
    return best, end


class Matcher:
    """A block of benchmark items: their pieces, hashed, and their patterns."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_words: int, min_chars: int, chance: bool = False):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        pieces: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            number, characters = volume_of(words)
            short = number < min_words
            by_chance = short and characters < min_chars
            if not words or by_chance and not chance:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
            budget = 0 if short else int(error_rate * len(ids))
            masks: dict[int, int] = defaultdict(int)
            back: dict[int, int] = defaultdict(int)
            for i, w in enumerate(ids.tolist()):
                masks[w] |= 1 << i
                back[w] |= 1 << (len(ids) - 1 - i)
            number = len(self.items)
            self.items.append((item_id, len(ids), budget, dict(masks), dict(back), by_chance))
            cuts = np.linspace(0, len(ids), budget + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                width = min(ANCHOR, int(b - a))
                pieces[width][int(self.hashes(ids[a : a + width], width)[0])].append((number, int(a), ids[a:b]))
        self.pieces = {w: dict(p) for w, p in pieces.items()}
        self.sieves = {}
        for width, known in self.pieces.items():
            sieve = np.zeros(1 << 16, dtype=bool)
            sieve[np.array(list(known), dtype=np.uint64) >> np.uint64(48)] = True
            self.sieves[width] = sieve

    @staticmethod
    def hashes(ids: np.ndarray, width: int) -> np.ndarray:
        n = len(ids) - width + 1
        h = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(width):
            h = (h + ids[k : k + n]) * MULTIPLIER
            h ^= h >> np.uint64(29)
        return h * MULTIPLIER

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int, bool]]:
        """(item, its words, distance, first word, end, whether it may be chance) of the best stretch of each item within its error budget."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.uint64)
        starts: dict[int, set[int]] = defaultdict(set)
        for width, known in self.pieces.items():
            h = self.hashes(ids, width)
            for p in np.flatnonzero(self.sieves[width][h >> np.uint64(48)]).tolist():
                for number, offset, piece in known.get(int(h[p]), ()):
                    if np.array_equal(ids[p : p + len(piece)], piece):
                        starts[number].add(p - offset)
        found = []
        for number, begins in starts.items():
            item_id, length, budget, masks, back, by_chance = self.items[number]
            best = (budget + 1, 0, 0)
            low = high = None
            for s in [*sorted(begins), None]:
                a, b = (max(0, s - budget), min(len(ids), s + length + budget)) if s is not None else (None, None)
                if low is not None and (a is None or a > high):
                    distance, end = best_match(masks, length, ids[low:high])
                    if distance < best[0]:
                        width = self._width(back, length, ids[low : low + end], distance)
                        best = (distance, low + end - width, low + end)
                    low = None
                if a is not None:
                    low, high = (a, b) if low is None else (low, max(high, b))
            if best[0] <= budget:
                found.append((item_id, length, *best, by_chance))
        return sorted(found, key=lambda m: (m[0] is None, m))

    @staticmethod
    def _width(back: dict[int, int], length: int, text: np.ndarray, distance: int) -> int:
        """Words of the stretch that ends with ``text``: where the mirrored pattern, from the end, is first as near."""
        return best_match(back, length, text[::-1][: length + distance])[1]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, max_block_mb: float) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``max_block_mb`` at most, one at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    volume = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // int(max_block_mb * 1e6)))
    for k in range(blocks):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.2, min_words: int = 5, min_chars: int = 16, chance: bool = False, max_block_mb: float = 8.0) -> DataFrame:
    """Passages of every whole text that match a benchmark item with few edits.

    Words are compared without case and punctuation; in scripts without spaces
    (Chinese, Japanese, Thai and their like) each character is a word.  An item of n words may be
    off by k = floor(error_rate * n) words put in, left out or changed; cut into
    k + 1 pieces, one of them must stand in the text as it is.  Pieces are looked
    up by hash at every place of the text; each hit gives the stretch in which
    the item must lie, and Myers' bit-parallel distance decides.

    Returns a row for each document and item that match: the id, ``item_id``,
    ``item_words``, ``distance``, ``first_word`` and ``end_word`` of the item's
    best stretch (the first, if several are as near; words from 0, end
    exclusive) and ``by_chance``.  Documents without a match have no row.

    An item of under ``min_words`` words (two Chinese or Japanese characters, or
    four of Thai and its neighbours, count as one) must match exactly; if it also
    has under ``min_chars`` letters and digits (a Chinese or Japanese one counts
    twice), any text may have it by chance: its exact matches are reported as
    ``by_chance`` if ``chance`` is set, and left to the caller; else it matches
    nothing.

    Null or empty texts and items match nothing.  Null ids and
    repeated rows: rows of their own.  Repeated items match each.  Other columns
    are ignored.  The benchmark is a stated query set: it is taken in blocks of
    ``max_block_mb``, each sent to all tasks; nothing else moves.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id string, item_id {item_type}, item_words int, distance int, first_word int, end_word int, by_chance boolean"
    out = None
    for items in blocks_of(benchmark, item_col, item_text_col, max_block_mb):
        matcher = Matcher(items, error_rate, min_words, min_chars, chance)

        def scan(frames: Iterator[pd.DataFrame], matcher: Matcher = matcher) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [(i, *m) for i, t in zip(frame["id"], frame["text"], strict=True) for m in matcher.matches(t)]
                yield pd.DataFrame(rows, columns=["id", "item_id", "item_words", "distance", "first_word", "end_word", "by_chance"], dtype=object)

        found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(scan, schema)
        out = found if out is None else out.unionAll(found)
    return out.select(F.col("id").cast(id_type).alias(id_col), "item_id", "item_words", "distance", "first_word", "end_word", "by_chance")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.2, min_words: int = 5, min_chars: int = 16, max_block_mb: float = 8.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which ``find_leaks`` finds nothing; no shuffle."""
    for items in blocks_of(benchmark, item_col, item_text_col, max_block_mb):
        docs = docs.where(_is_clean(Matcher(items, error_rate, min_words, min_chars))(F.col(text_col)))
    return docs


def _is_clean(matcher: Matcher):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not matcher.matches(t) for t in texts], dtype=bool)

    return clean
