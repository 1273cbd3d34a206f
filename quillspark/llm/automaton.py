"""A combined deterministic automaton: regexes to NFA, subset construction, minimisation, transition rows.

Patterns are over bytes: literals, ``[...]`` classes with ranges and ``^``, ``( )``, ``|``, ``? * +`` and
``{m}`` / ``{m,n}``. A class never includes bytes from 0x80 up, so multi-byte characters end a match.
"""

from __future__ import annotations

import numpy as np

ASCII = frozenset(range(128))


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self):
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self):
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("seq", items)

    def repeated(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                lo, hi = int(low), int(high or low)
                node = ("seq", [node] * lo + [("opt", node)] * (hi - lo))
            else:
                node = {"?": ("opt", node), "*": ("star", node), "+": ("seq", [node, ("star", node)])}[c]
        return node

    def escaped(self):
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            self.take()
            return node
        if c == "[":
            negated = self.peek() == "^"
            self.i += negated
            found: set[int] = set()
            while self.peek() != "]":
                a = self.take()
                a = self.escaped() if a == "\\" else ord(a)
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    b = self.take()
                    b = self.escaped() if b == "\\" else ord(b)
                    found.update(range(a, b + 1))
                else:
                    found.add(a)
            self.take()
            return ("set", frozenset(ASCII - found if negated else found))
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))


def _reverse(node):
    kind, x = node
    if kind == "seq":
        return ("seq", [_reverse(n) for n in reversed(x)])
    if kind == "alt":
        return ("alt", [_reverse(n) for n in x])
    return node if kind == "set" else (kind, _reverse(x))


class Automaton:
    """``next[state][byte]``: the next state, or -1; ``accepts[state]``: the set of rules that end there.

    ``search`` lets a match begin anywhere (the start state stays alive); ``backward`` reads rules reversed.
    """

    def __init__(self, patterns: list[str], search: bool = False, backward: bool = False):
        self._moves: list[list[tuple[frozenset, int]]] = []
        self._free: list[list[int]] = []
        start = self._state()
        ends = {}
        for rule, p in enumerate(patterns):
            node = _Parser(p).alternatives()
            first, last = self._build(_reverse(node) if backward else node)
            self._free[start].append(first)
            ends[last] = rule
        if search:
            self._moves[start].append((frozenset(range(256)), start))
        self._determinise(start, ends)
        self._minimise()

    def _state(self) -> int:
        self._moves.append([])
        self._free.append([])
        return len(self._moves) - 1

    def _build(self, node) -> tuple[int, int]:
        kind, x = node
        a, b = self._state(), self._state()
        if kind == "set":
            self._moves[a].append((x, b))
        elif kind == "seq":
            at = a
            for n in x:
                first, last = self._build(n)
                self._free[at].append(first)
                at = last
            self._free[at].append(b)
        else:
            for n in x if kind == "alt" else [x]:
                first, last = self._build(n)
                self._free[a].append(first)
                self._free[last].append(b)
                if kind == "star":
                    self._free[last].append(first)
            if kind in ("opt", "star"):
                self._free[a].append(b)
        return a, b

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self._free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _determinise(self, start: int, ends: dict[int, int]) -> None:
        sets = {m[0] for moves in self._moves for m in moves}
        kinds: dict[tuple, int] = {}
        ordered = sorted(sets, key=sorted)
        klass = np.array([kinds.setdefault(tuple(b in s for s in ordered), len(kinds)) for b in range(256)])
        sample = [int(np.flatnonzero(klass == k)[0]) for k in range(len(kinds))]
        first = self._closure([start])
        number, todo, rows, accepts = {first: 0}, [first], [], []
        for now in todo:
            accepts.append(frozenset(ends[s] for s in now if s in ends))
            row = []
            for b in sample:
                to = {t for s in now for chars, t in self._moves[s] if b in chars}
                if not to:
                    row.append(-1)
                    continue
                nxt = self._closure(to)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            rows.append(row)
        self._rows, self._accepts, self._class = np.array(rows), accepts, klass

    def _minimise(self) -> None:
        """Moore's refinement: split blocks until states of a block move to the same blocks."""
        named = {a: i for i, a in enumerate(dict.fromkeys(self._accepts))}
        block = np.array([named[a] for a in self._accepts])
        while True:
            signed = np.column_stack([block, np.where(self._rows < 0, -1, block[self._rows])])
            _, first, new = np.unique(signed, axis=0, return_index=True, return_inverse=True)
            new = new.reshape(-1)
            if len(first) == block.max() + 1:
                break
            block = new
        size = int(new.max()) + 1
        table = np.full((size, 256), -1)
        accepts: list[frozenset] = [frozenset()] * size
        for s in first:
            row = self._rows[s]
            table[new[s]] = np.where(row < 0, -1, new[row])[self._class]
            accepts[new[s]] = self._accepts[s]
        self.next, self.accepts, self.start = table, accepts, int(new[0])


class Hit:
    """Stands for an accepting state in the rows: it can't be indexed, which ends the inner loop."""

    __slots__ = ("row", "rules")


def linked_rows(dfa: Automaton) -> list:
    """Each state as a list of 256 next rows; a move into an accepting state gives its :class:`Hit`."""
    rows = [[None] * 256 for _ in dfa.accepts]
    hits = {}
    for s, rules in enumerate(dfa.accepts):
        if rules:
            hits[s] = h = Hit()
            h.row, h.rules = rows[s], rules
    for s, row in enumerate(rows):
        row[:] = [hits.get(t, rows[t]) for t in dfa.next[s].tolist()]
    return rows[dfa.start]
