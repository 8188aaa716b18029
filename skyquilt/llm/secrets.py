"""Secret scan: all rules in one deterministic automaton, one pass over the bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.automaton import compile_rules, mirrored, parse, rows_of

_VALUE = "[A-Za-z0-9+/_.=-]"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEY = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
_ASSIGN = _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?"

# Kind, trigger (whose first end tells that a match has begun), whole pattern, least length of the match,
# least length of its value after the marks (assign only).  The first three are the base, in order.
RULES = [
    ("assign", _ASSIGN + _VALUE, _ASSIGN + _VALUE + "+", 0, 8),
    ("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 16, 0),
    ("hex", "[0-9a-f]{32}", "[0-9a-f]+", 32, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]+", 40, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9]", "xox[abprs]-[A-Za-z0-9-]+", 20, 0),
    ("google", "AIza[A-Za-z0-9_-]", "AIza[A-Za-z0-9_-]+", 39, 0),
    ("stripe", "[rs]k_(live|test)_[A-Za-z0-9]", "[rs]k_(live|test)_[A-Za-z0-9]+", 24, 0),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
BASE = ("assign", "access", "hex")


class Scanner:
    """The compiled rules: one trigger automaton for all, and per rule the anchored and the mirrored one."""

    def __init__(self, rules: list[tuple] = RULES):
        self.rules = rules
        self.triggers = compile_rules([parse(r[1]) for r in rules], anywhere=True)
        self.whole = [compile_rules([parse(r[2])], anywhere=False) for r in rules]
        self.back = [compile_rules([mirrored(parse(r[1]))], anywhere=False) for r in rules]
        self.prefix = compile_rules([parse(_ASSIGN)], anywhere=False)
        self.ready = None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def _link(self):
        if self.ready is None:
            dead = lambda t, e: np.flatnonzero((t == np.arange(len(t))[:, None]).all(axis=1) & (e == 0))
            link = lambda m: ((rows := rows_of(*m)), {id(rows[i]) for i in dead(*m)})
            self.ready = (rows_of(*self.triggers), [link(m) for m in self.whole], [link(m) for m in self.back], link(self.prefix))
        return self.ready

    @staticmethod
    def _longest(machine, data: bytes, begin: int, stop: int, step: int) -> int | None:
        """Farthest end of a match from ``begin`` towards ``stop``."""
        rows, dead = machine
        row, best = rows[0], None
        for i in range(begin, stop, step):
            row = row[data[i]]
            if row[256]:
                best = i
            elif id(row) in dead:
                break
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order; per rule leftmost, longest and without overlap; failing matches are passed over."""
        trigger, whole, back, prefix = self._link()
        events = []
        row = trigger[0]
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                events.append((i, row[256]))
        found, passed = [], [0] * len(self.rules)
        for i, bits in events:
            rule = 0
            while bits:
                if bits & 1 and i >= passed[rule]:
                    # the leftmost start whose trigger ends here, not before the last match
                    start = self._longest(back[rule], data, i, passed[rule] - 1, -1)
                    if start is not None:
                        end = self._longest(whole[rule], data, start, len(data), 1) + 1
                        passed[rule] = end
                        _, _, _, least, least_value = self.rules[rule]
                        good = end - start >= least
                        if least_value:
                            marks = self._longest(prefix, data, start, end, 1) + 1
                            good = end - marks >= least_value
                        if good:
                            found.append((start, rule, end))
                bits >>= 1
                rule += 1
        return sorted(found)


def secret_frames(scanner: Scanner, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [r[0] for r in scanner.rules]
    kinds = len(BASE)
    for frame in frames:
        out = []
        for text in frame["text"]:
            data = ("" if text is None else text).encode("utf-8", "surrogatepass")
            spans = scanner.spans(data)
            if spans and not data.isascii():
                chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                at = lambda i: int(chars[i - 1]) if i else 0
                spans = [(at(s), r, at(e)) for s, r, e in spans]
            counts = [sum(r == k for _, r, _ in spans) for k in range(kinds)]
            join = lambda some: ",".join(f"{names[r]}:{s}:{e}" for s, r, e in some)
            base = join([x for x in spans if x[1] < kinds])
            out.append((*counts, hashlib.sha256(base.encode()).hexdigest(), join(spans)))
        got = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        got.insert(0, "id", frame["id"].to_numpy())
        yield got


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """Secrets of every whole text, found in one pass over its bytes.

    All rules' triggers are compiled, by subset construction and minimisation,
    into one automaton of transition rows; reading a byte is one lookup for all
    rules.  Where a trigger ends, the rule's mirrored automaton gives the leftmost
    start and its anchored one the longest end.  Matches of a kind do not overlap.

    Returns, per row of ``docs``: the id, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256`` (of the base spans, joined) and ``spans`` (kind:start:end of
    all rules by start, then kind as listed; code points, end exclusive).

    Null or empty text: no spans.  Null ids and repeated rows: rows of their own.
    Empty table: no rows.  Other columns are ignored.  No shuffle: each row is
    read once where it lies, in time that grows with its length.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    scanner = Scanner(rules)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(lambda frames: secret_frames(scanner, frames), schema)
    return found.withColumnRenamed("id", id_col)
