"""Edit distance, similarity and error rates over characters and words; word alignment."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .text import WS, let

ALIGNMENT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("dist", "correct", "substitutions", "deletions", "insertions")])


def char_distance(a: Column, b: Column) -> Column:
    """Unit-cost distance in code points."""
    return F.levenshtein(a, b)


def _share(distance: Column, size: Column, if_empty: float) -> Column:
    return F.when(size == 0, F.lit(if_empty)).otherwise(1 - distance / size)


def similarity(distance: Column, n: Column, m: Column) -> Column:
    """1 - distance / the longer; 1 for two empty sides."""
    return _share(distance, F.greatest(n, m), 1.0)


def char_accuracy(distance: Column, n: Column) -> Column:
    """1 - distance / reference; 1 for an empty reference, below 0 if there are more errors than characters."""
    return _share(distance, n, 1.0)


def word_error_rate(distance: Column, n: Column) -> Column:
    """Distance / reference words; 0 without any."""
    return F.when(n == 0, F.lit(0.0)).otherwise(distance / n)


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of token arrays: each distinct token becomes one character (UTF-32), then the built-in distance."""

    def coded(words: Column, distinct: Column) -> Column:
        # numbers from 256 on; those of surrogates are stepped over
        def code(w: Column) -> Column:
            n = F.array_position(distinct, w) + 255
            return F.decode(F.unhex(F.lpad(F.hex(F.when(n >= 0xD800, n + 0x800).otherwise(n)), 8, "0")), "UTF-32")

        return F.array_join(F.transform(words, code), "")

    return let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("all")), lambda x: F.levenshtein(coded(x.a, x["all"]), coded(x.b, x["all"])))


def align_native(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: _align_native(x.a, x.b))


def _align_native(a: Column, b: Column) -> Column:
    """Alignment counts by a fold over the distance table's rows, without Python. Good for some hundred cells.

    A cell prefers a match, then a substitution, a deletion, an insertion: the split that a backtrace from the end gives.
    """

    def cell(d, c, s, x, i):
        return F.struct(d.cast("int").alias("d"), c.cast("int").alias("c"), s.cast("int").alias("s"), x.cast("int").alias("x"), i.cast("int").alias("i"))

    zero = F.lit(0)
    top = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: cell(j, zero, zero, zero, j))

    def row(above: Column, word: Column) -> Column:
        first = F.get(above, F.lit(0))

        def along(cells: Column, j: Column) -> Column:
            left, up, diag = F.get(cells, F.size(cells) - 1), F.get(above, j), F.get(above, j - 1)
            new = (
                F.when(F.get(b, j - 1) == word, cell(diag.d, diag.c + 1, diag.s, diag.x, diag.i))
                .when(diag.d <= F.least(up.d, left.d), cell(diag.d + 1, diag.c, diag.s + 1, diag.x, diag.i))
                .when(up.d <= left.d, cell(up.d + 1, up.c, up.s, up.x + 1, up.i))
                .otherwise(cell(left.d + 1, left.c, left.s, left.x, left.i + 1))
            )
            return F.concat(cells, F.array(new))

        start = F.array(cell(first.d + 1, first.c, first.s, first.x + 1, first.i))
        return F.when(F.size(b) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), start, along))

    last = F.aggregate(a, top, row)
    end = F.element_at(last, -1)
    return F.struct(end.d.alias("dist"), end.c.alias("correct"), end.s.alias("substitutions"), end.x.alias("deletions"), end.i.alias("insertions"))


def _numbered(a: list, b: list) -> dict:
    """For each element of ``a`` the bits of its places."""
    bits: dict = {}
    for i, w in enumerate(a):
        bits[w] = bits.get(w, 0) | 1 << i
    return {w: bits[w] for w in set(b) & bits.keys()}


#: Bits of a table's columns that are kept at once, both kinds together; of larger tables only some columns are.
TABLE_BITS = 1 << 27


class _Places:
    """As :func:`_numbered`, for long lists of many different words: bits are made when asked for, those of frequent words are kept."""

    OFTEN = 200

    def __init__(self, a: list, b: list):
        self.places: dict = {w: [] for w in set(b)}
        for i, w in enumerate(a):
            if w in self.places:
                self.places[w].append(i)
        self.kept: dict = {}

    def get(self, w, _=0) -> int:
        if w in self.kept:
            return self.kept[w]
        places = self.places[w]
        if not places:
            return 0
        data = bytearray(places[-1] // 8 + 1)
        for i in places:
            data[i >> 3] |= 1 << (i & 7)
        bits = int.from_bytes(data, "little")
        if len(places) > self.OFTEN:
            self.kept[w] = bits
        return bits


def distance(a, b) -> int:
    """Unit-cost distance of two strings or lists, a whole column of the table at a time in the bits of an integer."""
    n, m = len(a), len(b)
    first = 0
    while first < n and first < m and a[first] == b[first]:
        first += 1
    while n > first and m > first and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[first:n], b[first:m]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places, full, top = (_numbered if len(a) * len(set(a)) <= TABLE_BITS else _Places)(a, b), (1 << len(a)) - 1, len(a) - 1
    up, down, d = full, 0, len(a)
    for w in b:
        same = places.get(w, 0)
        zero = (((same & up) + up) ^ up) | same | down
        right, left = down | full & ~(zero | up), up & zero
        d += (right >> top & 1) - (left >> top & 1)
        right = right << 1 | 1
        up, down = full & (left << 1 | ~(zero | right)), right & zero & full
    return d


class _Columns:
    """The columns of a distance table, from its end to its start.

    A column is two integers: in which rows the diagonal step costs nothing, and in which the value is one more than in the
    row above. If a table has more than ``TABLE_BITS`` of them, only every ``step``-th column's state is kept on the way
    forward, and the columns in between are made anew, block by block, on the way back: memory grows with the
    square root of the columns, at twice the time.
    """

    def __init__(self, ref: list, hyp: list):
        self.hyp, self.full = hyp, (1 << len(ref)) - 1
        m = len(hyp)
        self.places = (_numbered if len(ref) * len(set(ref)) <= TABLE_BITS else _Places)(ref, hyp)
        self.step = max(1, m if 2 * m * len(ref) <= TABLE_BITS else math.isqrt(m))
        self.free: list[int] = []
        self.rising: list[int] = []
        self.states = [(self.full, 0)]
        self.first = 0
        for start in range(0, m, self.step):
            self.first = start
            self._block(keep=start + self.step >= m)

    def _block(self, keep: bool) -> None:
        """Columns from ``first`` + 1 on, up to a step's number of them."""
        up, down = self.states[self.first // self.step]
        places, full, free, rising = self.places, self.full, [], []
        for w in self.hyp[self.first : self.first + self.step]:
            same = places.get(w, 0)
            zero = (((same & up) + up) ^ up) | same | down
            right, left = (down | full & ~(zero | up)) << 1 | 1, (up & zero) << 1
            up, down = full & (left | ~(zero | right)), right & zero & full
            if keep:
                free.append(zero)
                rising.append(up)
        if self.first // self.step + 1 == len(self.states):
            self.states.append((up, down))
        self.free, self.rising = free, rising

    def at(self, column: int) -> tuple[int, int]:
        """(free, rising) of a column, from 1 on; columns are asked for in descending order."""
        if column <= self.first:
            self.first = (column - 1) // self.step * self.step
            del self.states[self.first // self.step + 1 :]
            self._block(keep=True)
        return self.free[column - 1 - self.first], self.rising[column - 1 - self.first]


def align_words(ref: list, hyp: list) -> tuple[int, int, int, int, int]:
    """(distance, correct, substituted, deleted, inserted) by the backtrace from the table's end."""
    n, m = len(ref), len(hyp)
    correct = substituted = deleted = inserted = 0
    while n and m and ref[n - 1] == hyp[m - 1]:
        n, m, correct = n - 1, m - 1, correct + 1
    columns = _Columns(ref[:n], hyp[:m])
    while n and m:
        if ref[n - 1] == hyp[m - 1]:
            n, m, correct = n - 1, m - 1, correct + 1
            continue
        free, rising = columns.at(m)
        if not free >> (n - 1) & 1:
            n, m, substituted = n - 1, m - 1, substituted + 1
        elif rising >> (n - 1) & 1:
            n, deleted = n - 1, deleted + 1
        else:
            m, inserted = m - 1, inserted + 1
    deleted, inserted = deleted + n, inserted + m
    return substituted + deleted + inserted, correct, substituted, deleted, inserted


#: Rows whose texts and tokens are Python values at a time; an Arrow batch may hold thousands.
HELD = 64


def _each(fn, kind: T.StructType, *columns: pa.Array) -> pa.Array:
    """``fn`` of each row, a few rows at a time; nulls where one of the first two cells is null."""
    none, rows = (None,) * len(kind), []
    for at in range(0, len(columns[0]), HELD):
        held = zip(*(c.slice(at, HELD).to_pylist() for c in columns), strict=True)
        rows += [none if row[0] is None or row[1] is None else fn(*row) for row in held]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(len(kind))], names=kind.names)


@F.arrow_udf(ALIGNMENT)
def align(a: pa.Array, b: pa.Array) -> pa.Array:
    """Alignment counts of token arrays, in Arrow batches, one pair's table at a time."""
    return _each(align_words, ALIGNMENT, a, b)


_WORD = re.compile("[^" + re.sub(r"\\x\{(\w+)\}", lambda code: f"\\U{int(code[1], 16):08x}", WS) + "]+")


def words(text: str) -> list[str]:
    """Words as :func:`.text.tokenize` has them."""
    return _WORD.findall(text)


COMPARISON = T.StructType([T.StructField("chars", T.IntegerType()), *ALIGNMENT.fields])


@F.arrow_udf(COMPARISON)
def compare(ref: pa.Array, hyp: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Character distance of texts and alignment counts of their tokens, in one passage through Arrow."""
    return _each(lambda x, y, v, w: (distance(x, y), *align_words(v, w)), COMPARISON, ref, hyp, a, b)


@F.arrow_udf(COMPARISON)
def compare_texts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """As :func:`compare`, with the words taken here: a batch with tokens is two and a half times as large, and a worker has two or three."""
    return _each(lambda x, y: (distance(x, y), *align_words(words(x), words(y))), COMPARISON, ref, hyp)
