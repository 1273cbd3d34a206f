"""Benchmark decontamination: pigeonhole edit matching over words.

Texts and items are lower-cased (A-Z) and reduced to words of letters and digits. An item of n words may occur with up
to k = n * ``PERCENT`` // 100 words changed, left out or put in. Cut into k + 1 pieces, at least one of them is then
untouched, so an automaton of all items' pieces reads each text once; around every piece hit the item is verified with
Myers' bit-parallel distance, in its form for occurrences inside a longer text.

An item of under seven words has no error budget and is found where it stands word for word; callers to whom such items say
nothing about where a text is from leave them out by ``least``.

Items come in blocks of at most ``BLOCK`` bytes of text: each block's automaton is bounded and all texts are scanned
against it. An item longer than that is a block of its own. Null or empty items and texts match nothing; repeated items and
rows give repeated rows of the result; no rows or no items give no row. Of occurrences with equal distance the one that
ends first counts. A long text is verified around its piece hits only. The result has the id and the named columns alone, so other
columns, whatever their names, don't matter; an id column of such a name is replaced by it.
"""

from __future__ import annotations

import uuid
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_batches, record_batch, text_bytes
from .licenses import words_of

PERCENT = 15
LEAST = 1
BLOCK = 16 << 20


def myers(pattern: list, text: list) -> list[int]:
    """For each place of ``text``, the least edit distance of ``pattern`` to some stretch that ends there."""
    m = len(pattern)
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


def _split(joined: str) -> list[str]:
    """The words between the spaces at either end: none in a text of marks alone."""
    return joined[1:-1].split(" ") if len(joined) > 2 else []


class Matcher:
    """All pieces of a block of items. Words are joined by single spaces, with one at either end of a piece."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int, least: int):
        self.items = []
        self.pieces = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int, int]]] = {}
        for number, text in items:
            words = _split(words_of(text).decode("utf-8", "replace"))
            if len(words) < max(1, least):
                continue
            k = len(words) * percent // 100
            at = [len(words) * j // (k + 1) for j in range(k + 2)]
            for lo, hi in zip(at, at[1:]):
                found.setdefault(f" {' '.join(words[lo:hi])} ", []).append((len(self.items), lo, hi))
            self.items.append((number, words, k))
        for piece, where in found.items():
            self.pieces.add_word(piece, where)
        if found:
            self.pieces.make_automaton()

    def scan(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(item number in the block, distance, first word, words) of the best occurrence of each item in the text."""
        if not self.items:
            return []
        joined = words_of(data).decode("utf-8", "replace")
        hits = [(end, where) for end, where in self.pieces.iter(joined)]
        if not hits:
            return []
        words = _split(joined)
        windows: dict[int, list[tuple[int, int]]] = {}
        before, place = 0, 0
        for end, where in hits:
            before, place = before + joined.count(" ", place, end), end
            last = before  # words up to the piece's end
            for item, lo, hi in where:
                _, own, k = self.items[item]
                first = last - (hi - lo)
                span = (max(0, first - lo - k), min(len(words), first - lo + len(own) + k))
                spans = windows.setdefault(item, [])
                if spans and span[0] <= spans[-1][1]:
                    spans[-1] = (min(span[0], spans[-1][0]), max(span[1], spans[-1][1]))
                else:
                    spans.append(span)
        out = []
        for item, spans in windows.items():
            _, own, k = self.items[item]
            best = None
            for lo, hi in spans:
                scores = myers(own, words[lo:hi])
                d = min(scores)
                if d <= k and (best is None or d < best[0]):
                    end = scores.index(d) + lo
                    # the stretch's start: the reversed item, read backward from its end
                    back = myers(own[::-1], words[lo : end + 1][::-1])
                    best = (d, end - back.index(min(back)), end + 1)
            if best:
                out.append((item, best[0], best[1], best[2] - best[1]))
        return out


def _matchers_of(df: DataFrame, items: DataFrame, item_id: str, item_text: str, percent: int, least: int, block: int):
    """For each block of items a function that gives its matcher inside of a task."""
    sized = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("body")).where("body is not null")
    for part in _bounded(sized, block):
        held, name = df.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex
        yield lambda held=held, name=name: _cached(name, held, percent, least)


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(id, item_id, distance, first_word, n_words): one row for each item that occurs in a text, its best occurrence."""
    kind, item_kind = df.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)
    out = []
    for of_block in _matchers_of(df, items, item_id, item_text, percent, least, block):

        def run(batch: pa.RecordBatch, of_block=of_block) -> pa.RecordBatch:
            matcher = of_block()
            row, item, rest = [], [], [[], [], []]
            for i, data in enumerate(text_bytes(batch, text_col)):
                for k, *found in matcher.scan(data):
                    row.append(i)
                    item.append(matcher.items[k][0])
                    for column, v in zip(rest, found, strict=True):
                        column.append(v)
            return record_batch(**{id_col: pc.take(batch.column(0), pa.array(row, pa.int64())), "item_id": pa.array(item, item_type), **{c: pa.array(v, pa.int64()) for c, v in zip(("distance", "first_word", "n_words"), rest, strict=True)}})

        out.append(map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, item_id {item_kind}, distance bigint, first_word bigint, n_words bigint"))
    empty = df.select(id_col).where("false").select(id_col, F.lit(None).cast(item_kind).alias("item_id"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "first_word", "n_words")])
    return reduce(DataFrame.union, out) if out else empty


def uncontaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` in whose text no item occurs, each row judged by itself and kept as it is: no join, no shuffle."""
    place = df.columns.index(text_col)
    for of_block in _matchers_of(df, items, item_id, item_text, percent, least, block):

        def run(batch: pa.RecordBatch, of_block=of_block) -> pa.RecordBatch:
            matcher = of_block()
            return batch.filter(pa.array([not matcher.scan(data) for data in text_bytes(batch, place)], pa.bool_()))

        df = map_batches(df, run, df.schema)
    return df


def _bounded(rows: DataFrame, block: int):
    """The rows in lists of at most ``block`` bytes of text, one at a time."""
    part, size = [], 0
    for r in rows.toLocalIterator():  # a partition at a time
        body = r["body"].encode()
        if part and size + len(body) > block:
            yield part
            part, size = [], 0
        part.append((r["item"], body))
        size += len(body)
    if part:
        yield part


_matchers: dict = {}


def _cached(name: str, held, percent: int, least: int) -> Matcher:
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(held.value, percent, least)
    return _matchers[name]
