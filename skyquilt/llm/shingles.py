"""Sets of hashed word shingles, computed with numpy for one text at a time."""

from __future__ import annotations

import numpy as np

BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 18  # bytes hashed at once


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashes of the n-word shingles of a text, A-Z lowered, words parted by ASCII white space.

    A text with fewer words is one shingle; without words it has none.
    """

    def __init__(self, n: int):
        self.n = n
        self.forth = self.back = np.ones(1, dtype=np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.forth) < size:
            size = max(size, CHUNK + 1)
            steps = np.full(size, BASE, dtype=np.uint64)
            steps[0] = 1
            self.forth = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(INVERSE)
            self.back = np.multiply.accumulate(steps)

    def _words(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words: differences of a running polynomial, brought to a common power."""
        self._powers(len(data) + 1)
        gap = SPACE[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        first, last = not gap[0], not gap[-1]
        cuts = np.concatenate([[0] if first else [], edge, [len(data)] if last else []]).astype(np.int64)
        starts, ends = cuts[::2], cuts[1::2]
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * self.forth[: len(data)], out=run[1:])
        return mixed((run[ends] - run[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * MIX)

    def words(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            if end < len(data):  # cut between words; a longer word than a chunk is taken whole
                gaps = np.flatnonzero(SPACE[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    later = np.flatnonzero(SPACE[data[end:]])
                    end = end + int(later[0]) + 1 if len(later) else len(data)
            parts.append(self._words(data[at:end]))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        n = min(self.n, len(words))
        m = len(words) - n + 1
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = mixed(h * MIX + words[k : k + m])
        return np.unique(h)
