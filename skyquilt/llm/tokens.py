"""Token counts under a unigram model: one forward pass over a trie of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # begins each pre-token, as in the vocabulary
PRIME = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_pieces(path: str) -> dict[str, float]:
    """Pieces of a public SentencePiece vocabulary and their log probabilities.

    The vocabulary is ordered by merge rank and has no probabilities, so these
    follow Zipf's law by rank, a rule and not a training.  Control and byte
    pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) and (p := model.id_to_piece(i))]
    norm = np.log(np.sum(1.0 / np.arange(1, len(pieces) + 1)))
    return {p: -float(np.log(rank) + norm) for rank, p in enumerate(pieces, 1)}


class TokenCounter:
    """Best segmentation of pre-tokens into pieces; a character of no piece costs one byte token for each of its bytes."""

    def __init__(self, pieces: dict[str, float], longest_in_trie: int = 64):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.longest_in_trie = longest_in_trie
        self.byte_cost = min(pieces.values()) - 10.0
        by_length: dict[int, list[tuple[int, float]]] = {}
        for piece, logp in pieces.items():
            by_length.setdefault(len(piece), []).append((int(self._hash(np.array([list(map(ord, piece))], dtype=np.uint64))[0, -1]), logp))
        self.tables = {}
        for n, some in by_length.items():
            some.sort()
            keys = np.array([h for h, _ in some], dtype=np.uint64)
            sieve = np.zeros(1 << 18, dtype=bool)
            sieve[(keys * SPREAD) >> np.uint64(46)] = True
            self.tables[n] = (keys, np.array([p for _, p in some]), sieve)
        steps = np.full(longest_in_trie + 2, PRIME)
        steps[0] = 1
        self.power = np.multiply.accumulate(steps)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Rolling hashes of all prefixes, column by column."""
        out = np.zeros_like(codes)
        h = np.zeros(len(codes), dtype=np.uint64)
        for j in range(codes.shape[1]):
            h = h * PRIME + codes[:, j] + np.uint64(1)
            out[:, j] = h
        return out

    def count_in_trie(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the distinct, sorted ``words``.

        A word's prefixes are nodes of the trie; in sorted order a prefix is a new
        node exactly where it is longer than what the word shares with the word
        before.  Depth by depth, each node gets its forward score once, from its
        ancestors' scores and the pieces that end in it; a word's count stands at
        its last node.
        """
        lengths = np.array([len(w) for w in words])
        most = int(lengths.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        codes = np.zeros((len(words), most), dtype=np.uint64)
        codes[np.arange(most)[None, :] < lengths[:, None]] = flat
        hashes = self._hash(codes)
        shared = np.zeros(len(words), dtype=np.int64)
        same = np.logical_and.accumulate((codes[1:] == codes[:-1]) & (codes[1:] != 0), axis=1)
        shared[1:] = same.sum(axis=1)
        node_of = np.zeros((len(words), most + 1), dtype=np.int64)  # number of the node among those of its depth
        scores, counts = [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
        for depth in range(1, most + 1):
            new = (lengths >= depth) & (shared < depth)
            node_of[:, depth] = np.maximum(np.cumsum(new) - 1, 0)
            rows = np.flatnonzero(new)
            last = codes[rows, depth - 1]
            size = 1 + (last >= 0x80).astype(np.int64) + (last >= 0x800) + (last >= 0x10000)
            parent = node_of[rows, depth - 1]
            best = scores[depth - 1][parent] + self.byte_cost * size
            number = counts[depth - 1][parent] + size
            for n in range(1, min(depth, self.longest) + 1):
                if n not in self.tables:
                    continue
                keys, logp, sieve = self.tables[n]
                h = hashes[rows, depth - 1]
                if depth > n:
                    h = h - hashes[rows, depth - n - 1] * self.power[n]
                maybe = np.flatnonzero(sieve[(h * SPREAD) >> np.uint64(46)])
                if not len(maybe):
                    continue
                at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[at] == h[maybe]
                maybe, at = maybe[hit], at[hit]
                ancestor = node_of[rows[maybe], depth - n]
                score = scores[depth - n][ancestor] + logp[at]
                better = score > best[maybe]
                maybe, ancestor = maybe[better], ancestor[better]
                best[maybe] = score[better]
                number[maybe] = counts[depth - n][ancestor] + 1
            scores.append(best)
            counts.append(number)
        out = np.zeros(len(words), dtype=np.int64)
        for depth in range(1, most + 1):
            rows = np.flatnonzero(lengths == depth)
            out[rows] = counts[depth][node_of[rows, depth]]
        return out

    def count_alone(self, word: str) -> int:
        """The same recurrence for one word, for words too long for the trie's matrix."""
        best, number = [0.0], [0]
        for depth in range(1, len(word) + 1):
            size = len(word[depth - 1].encode("utf-8", "surrogatepass"))
            top, n = best[depth - 1] + self.byte_cost * size, number[depth - 1] + size
            for k in range(1, min(depth, self.longest) + 1):
                logp = self.pieces.get(word[depth - k : depth])
                if logp is not None and best[depth - k] + logp > top:
                    top, n = best[depth - k] + logp, number[depth - k] + 1
            best.append(top)
            number.append(n)
        return number[-1]


def count_frames(counter: TokenCounter, frames: Iterator[pd.DataFrame], trie_words: int = 40_000, kept_words: int = 1_500_000) -> Iterator[pd.DataFrame]:
    known: dict[bytes, int] = {}
    for frame in frames:
        out = []
        for begin in range(0, len(frame), 1000):
            part = [("" if t is None else t).encode("utf-8", "surrogatepass").split() for t in frame["text"].iloc[begin : begin + 1000]]
            fresh = set(chain.from_iterable(part)).difference(known)
            if len(known) + len(fresh) > kept_words:
                known.clear()
                fresh = set(chain.from_iterable(part))
            words = sorted((MARK + w.decode("utf-8", "surrogatepass"), w) for w in fresh)
            long = [x for x in words if len(x[0]) > counter.longest_in_trie or "\x00" in x[0]]
            known.update((w, counter.count_alone(s)) for s, w in long)
            skip = {w for _, w in long}
            words = [x for x in words if x[1] not in skip]
            for at in range(0, len(words), trie_words):
                some = words[at : at + trie_words]
                known.update(zip((w for _, w in some), counter.count_in_trie([s for s, _ in some]).tolist(), strict=True))
            out += [(len(ws), sum(map(known.__getitem__, ws))) for ws in part]
        got = pd.DataFrame(out, columns=["n_words", "n_tokens"])
        got.insert(0, "id", frame["id"].to_numpy())
        yield got


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of every whole text under a unigram model over a public vocabulary.

    Pre-tokens are the runs of other characters between ASCII white space, each
    with the word mark before it.  A task puts the distinct pre-tokens that it
    meets, in blocks, into a trie and computes the best segmentation's score once
    for each node, so pre-tokens share the work for what they begin with; the
    counts at the ends are kept (a bounded number; when that is reached the task
    starts afresh) and summed by document.

    Returns, per row of ``docs``: the id, ``n_words`` (pre-tokens) and
    ``n_tokens``.  Null or empty text: 0 and 0.  Null ids and repeated rows: rows
    of their own.  Empty table: no rows.  Other columns are ignored.  Nothing is
    shuffled; the vocabulary is read on the driver (its size is fixed) and sent
    to the tasks.
    """
    counter = TokenCounter(read_pieces(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(counter)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long"
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(lambda frames: count_frames(shared.value, frames), schema)
    return found.withColumnRenamed("id", id_col)
