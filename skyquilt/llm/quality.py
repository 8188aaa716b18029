"""Quality classifier: a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGITS = bytes(range(48, 58))
MARKS = b"#$%&*^~<>{}[]\\_=+@"
N_FEATURES = 14


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x N_FEATURES) and lengths of the lines of a text; an empty or null text is one empty line."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        data = line.encode("utf-8", "surrogatepass")
        n = len(data)
        words = data.split()
        k = len(words)
        count = lambda drop, data=data, n=n: n - len(data.translate(None, drop))
        letters, marks, shouts, bars = count(LETTERS), count(MARKS), data.count(b"!"), data.count(b"|")
        distinct = len(set(words)) / k if k else 1.0
        again = data in seen
        seen.add(data)
        rows.append((
            1.0, count(UPPER) / letters if letters else 0.0, count(DIGITS) / n if n else 0.0, min(1.0, bars / k) if k else 0.0, min(1.0, marks / k) if k else 0.0,
            min(1.0, shouts / k) if k else 0.0, distinct, float(k >= 8 and distinct < 0.5), min(1.0, math.log1p(k) / 6), min(1.0, (n - k) / k / 16) if k else 0.0,
            float(data[-1:] in b".?!" and n > 0), float(again and k > 2), float(k == 0), float(k < 4),
        ))
        sizes.append(len(line) + 1.0)
    return np.array(rows), np.array(sizes)


def with_neighbours(f: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it (zeros beyond the ends)."""
    gap = np.zeros((1, f.shape[1]))
    return np.hstack([f, np.vstack([gap, f[:-1]]), np.vstack([f[1:], gap])])


class LineField:
    """Two labels a line; weights of the features for 'good', and of the four label pairs of neighbours."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.pairs, self.scale, self.shift = weights, pairs, scale, shift

    def marginals(self, logits: np.ndarray, lengths: np.ndarray, pairwise: bool = False):
        """Forward-backward over padded chains (docs x lines): the chance of 'good' of each line, and the expected label pairs."""
        docs, most = logits.shape
        pots = np.zeros((docs, most, 2))
        pots[:, :, 1] = logits
        inside = np.arange(most)[None, :] < lengths[:, None]
        forward, backward = np.zeros((docs, most, 2)), np.zeros((docs, most, 2))
        forward[:, 0] = pots[:, 0]
        for i in range(1, most):
            step = np.logaddexp(forward[:, i - 1, 0, None] + self.pairs[0], forward[:, i - 1, 1, None] + self.pairs[1]) + pots[:, i]
            forward[:, i] = np.where(inside[:, i, None], step, forward[:, i - 1])
        for i in range(most - 2, -1, -1):
            ahead = pots[:, i + 1] + backward[:, i + 1]
            step = np.logaddexp(self.pairs[:, 0] + ahead[:, 0, None], self.pairs[:, 1] + ahead[:, 1, None])
            backward[:, i] = np.where(inside[:, i + 1, None], step, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        good = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        good = np.where(inside, np.clip(good, 0.0, 1.0), 0.0)
        if not pairwise:
            return good, None
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                both = forward[:, :-1, a] + self.pairs[a, b] + pots[:, 1:, b] + backward[:, 1:, b] - total[:, None]
                expected[a, b] = np.exp(both)[inside[:, 1:]].sum()
        return good, expected

    def blocks(self, chains: list[np.ndarray], size: int = 256) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Chains of similar length together, padded."""
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        at = 0
        while at < len(order):
            take = [i for i in order[at : at + size] if len(chains[i]) * size <= 1_000_000] or order[at : at + 1]
            at += len(take)
            lengths = np.array([len(chains[i]) for i in take])
            logits = np.zeros((len(take), lengths.max()))
            for row, i in enumerate(take):
                logits[row, : lengths[row]] = chains[i] @ self.weights
            yield take, logits, lengths

    def raw(self, chains: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        out = np.zeros(len(chains))
        for take, logits, lengths in self.blocks(chains):
            good, _ = self.marginals(logits, lengths)
            for row, i in enumerate(take):
                out[i] = (good[row, : lengths[row]] * sizes[i]).sum() / sizes[i].sum()
        return out

    def score(self, chains: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        raw = np.clip(self.raw(chains, sizes), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.scale * np.log(raw / (1 - raw)) + self.shift)))


def train(chains: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, *, rounds: int = 200, penalty: float = 2.0, cut: float = 0.3) -> LineField:
    """Penalised conditional likelihood, by gradient steps with momentum and per-weight scaling; every line has its document's label.

    The score is then put through a logistic curve, fitted so that ``cut`` parts
    the classes with the best balanced accuracy on the training rows.
    """
    width = 3 * N_FEATURES
    field = LineField(np.zeros(width), np.zeros((2, 2)))
    if len(chains) == 0 or len(set(labels.tolist())) < 2:
        return field
    share = labels.mean()
    heavy = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both classes count alike
    m, v = np.zeros(width + 4), np.zeros(width + 4)
    for t in range(1, rounds + 1):
        grad, pair_grad = -penalty * field.weights, -penalty * field.pairs
        for take, logits, lengths in field.blocks(chains):
            for kind in (0, 1):
                rows = np.flatnonzero(labels[take] == kind)
                if not len(rows):
                    continue
                weight = heavy[take[rows[0]]]
                good, expected = field.marginals(logits[rows], lengths[rows], pairwise=True)
                for at, row in enumerate(rows):
                    i = take[row]
                    grad = grad + weight * ((kind - good[at, : lengths[row]]) @ chains[i])
                pair_grad = pair_grad - weight * expected
                pair_grad[kind, kind] += weight * (lengths[rows] - 1).sum()
        g = np.concatenate([grad, pair_grad.reshape(-1)]) / len(chains)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        field.weights = field.weights + step[:width]
        field.pairs = field.pairs + step[width:].reshape(2, 2)
    raw = np.clip(field.raw(chains, sizes), 1e-6, 1 - 1e-6)
    z = np.log(raw / (1 - raw))
    # the cut with the best balanced accuracy: halfway between neighbouring scores
    order = np.argsort(z, kind="stable")
    bad, good = np.cumsum(labels[order] == 0), np.cumsum(labels[order] == 1)
    balance = bad / bad[-1] + 1 - good / good[-1]
    best = int(np.argmax(balance[:-1])) if len(z) > 1 else 0
    edge = (z[order[best]] + z[order[best + 1]]) / 2
    field.scale = 0.5
    field.shift = math.log(cut / (1 - cut)) - field.scale * edge
    return field


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def stretch(doc_id: int, f: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` lines in a row."""
    at = zlib.crc32(str(doc_id).encode()) % (max(0, len(f) - most) + 1)
    return f[at : at + most], sizes[at : at + most]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 4000, max_lines: int = 200) -> LineField:
    """Learn from at most ``max_train`` labelled documents that are not held out, chosen by a hash of their id.

    Of a document with more than ``max_lines`` lines, that many lines in a row are
    learnt from, at a place that follows its id; so what the driver gets is bounded.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_train)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [stretch(i, *line_features(t), max_lines) for i, t in zip(frame["id"], frame["text"], strict=True)]
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "f": [f.reshape(-1) for f, _ in got], "size": [s for _, s in got]})

    # one row an id: copies of a row would count twice
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = texts.mapInPandas(features, "id long, label int, f array<double>, size array<double>").toPandas().sort_values("id")
    chains = [with_neighbours(np.asarray(f).reshape(-1, N_FEATURES)) for f in rows["f"]]
    return train(chains, [np.asarray(s) for s in rows["size"]], rows["label"].to_numpy(dtype=int))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_train: int = 4000, max_lines: int = 200) -> DataFrame:
    """Quality of every whole text as ``labels.quality`` marks it.

    A conditional random field labels each line good or bad from the features of
    the line and its two neighbours and from the neighbours' labels.  A
    document's score is the mean of its lines' forward-backward marginals,
    weighted by length, put through a fitted logistic curve.  Ids, languages and
    sources are no inputs; labels of rows whose crc32(id) mod 5 is 0 are never
    read.  The fit uses ``max_train`` documents and ``max_lines`` lines of each at
    most; all documents are scored, and whole.

    Returns the columns of ``docs`` and ``held_out``, ``score`` (0 to 1) and
    ``predicted`` (1 from ``threshold`` on).  Null or empty text: scored as one
    empty line.  Null ids and repeated rows: rows of their own.  Empty table: no
    rows.  Labels of no documents, or of one class: every score is 0.5.  Columns
    with the three names are replaced.  Scoring shuffles nothing.
    """
    field = fit(docs, labels, id_col=id_col, text_col=text_col, max_train=max_train, max_lines=max_lines)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            out = []
            for at in range(0, len(some), 512):
                got = [line_features(t) for t in some.iloc[at : at + 512]]
                out.append(field.score([with_neighbours(f) for f, _ in got], [s for _, s in got]))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out(F.col(id_col))).withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
