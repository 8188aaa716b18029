"""Regular expressions over bytes as one minimal deterministic automaton.

Only what the secret rules need is parsed: literals, escapes, classes, groups,
alternatives and the counts ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

import numpy as np


def parse(pattern: str):
    """Syntax tree: ('set', frozenset of bytes), ('cat', parts), ('alt', parts), ('rep', part, least, most or None)."""
    pos = 0

    def escape() -> int:
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c == "x":
            pos += 2
            return int(pattern[pos - 2 : pos], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def one_class() -> frozenset:
        nonlocal pos
        negative = pattern[pos] == "^"
        pos += negative
        members: set[int] = set()
        first = True
        while first or pattern[pos] != "]":
            first = False
            c = pattern[pos]
            pos += 1
            low = escape() if c == "\\" else ord(c)
            if pattern[pos] == "-" and pattern[pos + 1] != "]":
                pos += 1
                c = pattern[pos]
                pos += 1
                high = escape() if c == "\\" else ord(c)
                members.update(range(low, high + 1))
            else:
                members.add(low)
        pos += 1
        return frozenset(range(256)) - members if negative else frozenset(members)

    def atom():
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c == "(":
            inner = alternatives()
            pos += 1
            return inner
        if c == "[":
            return ("set", one_class())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset({escape() if c == "\\" else ord(c)}))

    def counted():
        nonlocal pos
        node = atom()
        while pos < len(pattern) and pattern[pos] in "?*+{":
            c = pattern[pos]
            pos += 1
            if c == "{":
                end = pattern.index("}", pos)
                low, comma, high = pattern[pos:end].partition(",")
                pos = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return node

    def sequence():
        parts = []
        while pos < len(pattern) and pattern[pos] not in "|)":
            parts.append(counted())
        return ("cat", parts)

    def alternatives():
        nonlocal pos
        parts = [sequence()]
        while pos < len(pattern) and pattern[pos] == "|":
            pos += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    return alternatives()


def mirrored(node):
    """The tree of the reversed language."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", mirrored(node[1]), *node[2:])
    parts = [mirrored(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class Nfa:
    """Thompson's construction; ``accepts`` maps end states to bits of rules."""

    def __init__(self):
        self.jumps: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []
        self.accepts: dict[int, int] = {}
        self.starts: list[int] = []

    def state(self) -> int:
        self.jumps.append([])
        self.moves.append(None)
        return len(self.jumps) - 1

    def add(self, node, begin: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[begin] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                inner = self.state()
                self.jumps[begin].append(inner)
                begin = self.add(part, inner)
            return begin
        if kind == "alt":
            ends = []
            for part in node[1]:
                inner = self.state()
                self.jumps[begin].append(inner)
                ends.append(self.add(part, inner))
            out = self.state()
            for e in ends:
                self.jumps[e].append(out)
            return out
        _, part, least, most = node
        for _ in range(least):
            inner = self.state()
            self.jumps[begin].append(inner)
            begin = self.add(part, inner)
        out = self.state()
        if most is None:
            loop = self.state()
            self.jumps[begin].append(loop)
            end = self.add(part, loop)
            after = self.state()
            self.jumps[end].append(after)
            again = self.state()
            self.jumps[after] += [out, again]
            self.jumps[again].append(loop)
            self.jumps[begin].append(out)
        else:
            for _ in range(most - least):
                self.jumps[begin].append(out)
                inner = self.state()
                self.jumps[begin].append(inner)
                begin = self.add(part, inner)
            self.jumps[begin].append(out)
        return out

    def rule(self, tree, bit: int) -> None:
        begin = self.state()
        self.starts.append(begin)
        end = self.add(tree, begin)
        self.accepts[end] = self.accepts.get(end, 0) | bit


def compile_rules(trees: list, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction and minimisation.

    Returns transitions (states x 256, state 0 starts) and, per state, the bits of
    the rules that end there.  anywhere: a rule may begin at each byte.
    """
    nfa = Nfa()
    for i, tree in enumerate(trees):
        nfa.rule(tree, 1 << i)

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.jumps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in nfa.accepts)

    # bytes that no rule tells apart move alike
    sets = {m[0] for m in nfa.moves if m}
    groups: dict[tuple, list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    kinds = list(groups.values())
    begin = closure(nfa.starts)
    index, order, table = {begin: 0}, [begin], []
    for now in order:
        row = []
        for kind in kinds:
            nxt = {m[1] for s in now if (m := nfa.moves[s]) and kind[0] in m[0]}
            to = closure(nxt | set(nfa.starts) if anywhere else nxt)
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        table.append(row)
    trans = np.array(table, dtype=np.int64)
    ends = np.array([sum({nfa.accepts[s] for s in now if s in nfa.accepts}) for now in order], dtype=np.int64)
    # Moore: split the classes of equal ends until the successors' classes agree
    part = np.unique(ends, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([part, part[trans]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    first = np.full(part.max() + 1, -1, dtype=np.int64)
    names: dict[int, int] = {}
    for s in range(len(part)):  # in the order found, so the start is 0
        if part[s] not in names:
            names[part[s]] = len(names)
            first[len(names) - 1] = s
    rename = np.array([names[p] for p in range(len(first))])[part] if len(first) else part
    small = rename[trans[first]]
    full = np.zeros((len(first), 256), dtype=np.int64)
    for k, kind in enumerate(kinds):
        full[:, kind] = small[:, [k]]
    return full, ends[first]


def rows_of(trans: np.ndarray, ends: np.ndarray) -> list:
    """Transitions as linked rows: row[byte] is the next row, row[256] the bits of the rules that end in it."""
    rows = [[None] * 257 for _ in range(len(trans))]
    for row, to, bits in zip(rows, trans.tolist(), ends.tolist(), strict=True):
        row[:256] = [rows[t] for t in to]
        row[256] = bits
    return rows
