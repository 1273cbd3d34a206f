"""Secret scans: all rules compiled into one automaton, found in one pass over the bytes of a text.

A rule is a short *trigger* and a *tail* class. The searching automaton of all triggers (subset construction,
minimised) reads each byte once; where it accepts, the reversed trigger gives the match's start, the tail class,
matched from there on, its end. Per rule, matches are leftmost and don't overlap; one that fails its least length is consumed and dropped.
Rules must be such that a match of a trigger doesn't lie inside a longer match of the same trigger.

Null text is empty text and gives no span. Each row is scanned for itself, so repeated rows give equal results. Spans of
different rules may overlap; each is given, in order of start, then rule. Long texts take time in proportion to their length, however
many matches they have. The result has the id and ``found`` alone, so other columns don't matter. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, Hit, linked_rows
from .common import map_batches, record_batch, text_bytes


@dataclass(frozen=True)
class Rule:
    kind: str
    trigger: str  #: ends with the first character of the measured part if ``measured`` is "tail"
    tail: str  #: a character class, taken as often as it fits; "" for none
    least: int  #: least length of the match, or of its measured tail
    measured: str = "match"
    base: bool = False


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# The rules' formats.
_VALUE = "[A-Za-z0-9+/_.=-]"
_KEYS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE_RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?{_VALUE}", _VALUE, 12, "tail", True),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", 18, "match", True),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]", 16, "match", True),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "[A-Za-z0-9]", 40),
    Rule("google", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 39),
    Rule("slack", "xox[abprs]-[A-Za-z0-9]", "[A-Za-z0-9-]", 20),
    Rule("jwt", "eyJ[A-Za-z0-9_-]", "[A-Za-z0-9_.-]", 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 20),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES):
        self.rules = rules
        self.first = linked_rows(Automaton([r.trigger for r in rules], search=True))
        self.back = [Automaton([r.trigger], backward=True) for r in rules]
        self.back = [(b.next.tolist(), [bool(a) for a in b.accepts], b.start) for b in self.back]
        self.tails = [self._class(r.tail) for r in rules]

    @staticmethod
    def _class(tail: str) -> re.Pattern | None:
        """Any number of the class's bytes, as its automaton has them."""
        if not tail:
            return None
        dfa = Automaton([tail])
        return re.compile(b"[%b]*" % b"".join(b"\\x%02x" % b for b in range(256) if dfa.next[dfa.start][b] >= 0))

    def _start(self, rule: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start, from ``least`` on, of a trigger that ends before ``end``; -1 if none."""
        moves, accepts, state = self.back[rule]
        found, at = -1, end
        while at > least:
            at -= 1
            state = moves[state][data[at]]
            if state < 0:
                break
            if accepts[state]:
                found = at
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, by start and rule."""
        out: list[tuple[int, int, int]] = []
        taken = [0] * len(self.rules)
        n, row, left = len(data), self.first, iter(data)
        while True:
            b = None
            try:
                for b in left:
                    row = row[b]
                b = None
            except TypeError:
                pass
            if row.__class__ is not Hit:
                return sorted(out)
            end = n - left.__length_hint__() - (b is not None)
            for k in row.rules:
                if end > taken[k]:
                    rule, start = self.rules[k], self._start(k, data, end, taken[k])
                    if start >= 0:
                        tail = self.tails[k]
                        stop = tail.match(data, end).end() if tail else end
                        taken[k] = stop
                        if stop - (end - 1 if rule.measured == "tail" else start) >= rule.least:
                            out.append((start, k, stop))
            if b is None:
                return sorted(out)
            row = row.row[b]


_scanner: dict = {}


def _cached(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanner:
        _scanner[rules] = Scanner(rules)
    return _scanner[rules]


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if data.isascii() or not spans:
        return spans
    places = sorted({x for s, _, e in spans for x in (s, e)})
    at, before, points = {}, 0, 0
    for p in places:
        points += len(data[before:p].decode("utf-8", "replace"))
        at[p], before = points, p
    return [(at[s], k, at[e]) for s, k, e in spans]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Per row: its id and ``found``, an array of (kind, start, end, base) in code points, end exclusive."""
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = _cached(rules)
        found = []
        for data in text_bytes(batch, text_col):
            spans = code_points(data, scanner.spans(data))
            found.append([{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, k, e in spans])
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        return record_batch(**{id_col: batch.column(0), "found": pa.array(found, pa.list_(item))})

    return map_batches(df.select(id_col, text_col), scan, f"`{id_col}` {kind}, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
