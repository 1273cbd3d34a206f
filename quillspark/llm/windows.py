"""Bounded-space online packing into windows that training pads to a fixed length.

A document's tokens and one end token are a stream. What fills whole windows is cut off from its start; the rest goes to the
best fitting of at most ``OPEN`` windows that a partition holds open, the one with the least room that still takes it. If
none takes it and all are open, the fullest is emitted: filled up with the head of the rest, so that it needs no padding, and
the search goes on with what is left. A full window is emitted at once. Thus a task holds ``OPEN`` windows, whatever
its partition's size, and documents are cut only where that saves padding.

The windows still open at a partition's end are merged, ``GROUP`` partitions at a time: the emptiest gives its pieces to
the best fitting others until one is left, which is cut into windows whose lengths are powers of two, the lengths that
aren't padded. So no window is padded at all.

Null text is empty text: the end token alone. Rows are packed as they are, repeated ones too; ids may be null or repeated. No
rows: no pieces. A very long text is held as its tokens, four bytes each, by the task that reads it. The result has the id
and the named columns alone, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, record_batch

CAPACITY = 1024
END = 0
OPEN = 32
GROUP = 64
# How the tokenizer's file says that texts are prepared, and its split pattern, the quantifiers made possessive
# where giving back can't help.
_FORM = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_SPLIT = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters of white space in a row that aren't left to the pattern's backtracking, whose stack ends at a million.
LONG = 100_000
_GAP = re.compile(rf"\s{{{LONG}}}")


class Encoder:
    """A byte-level tokenizer's ids as little-endian bytes.

    The vocabulary's numbers are the order of its merges, so they serve as ranks, and by ranks a text is encoded four times as fast as
    by the library whose file this is. That holds for texts in Latin-1, whose letters, digits and spaces are the same to
    every library. All others, those with a mark of a special token or with white space too long for the ranks' pattern, and all
    texts of a tokenizer of another form go through its own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.special = [t["content"] for t in form["added_tokens"]]
        self.ranked = _ranked(form) if form["pre_tokenizer"] == _FORM and form["normalizer"] is None and form["model"]["type"] == "BPE" else None

    def encode(self, text: str) -> bytes:
        if self.ranked and not any(s in text for s in self.special) and (len(text) < LONG or not _GAP.search(text)):
            try:
                text.encode("latin-1")
                return np.array(self.ranked(text), "<u4").tobytes()
            except UnicodeEncodeError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _ranked(form: dict):
    """The encoding by ranks, or None if the merges aren't in the order of the numbers."""
    import tiktoken

    vocab = form["model"]["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in form["model"]["merges"]]
    if merged != sorted(merged) or form["model"].get("ignore_merges"):
        return None
    # byte-level form: printable bytes stand for themselves, the others for the characters from U+0100 on
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {bytes(map(back.__getitem__, token)): n for token, n in vocab.items() if all(c in back for c in token)}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Windows:
    """Open windows, sorted by their room and then by age.

    A piece is (what it is of, first token, ids). ``emit`` gets the pieces of each full window.
    """

    def __init__(self, capacity: int, most: int, emit):
        self.capacity, self.most, self.emit = capacity, most, emit
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def open(self, pieces: list = ()) -> None:
        self.held[self.made] = list(pieces)
        insort(self.rooms, (self.capacity - sum(len(p[2]) for p in pieces) // 4, self.made))
        self.made += 1

    def _put(self, at: int, piece: tuple) -> None:
        room, w = self.rooms.pop(at)
        room -= len(piece[2]) // 4
        self.held[w].append(piece)
        if room:
            insort(self.rooms, (room, w))
        else:
            self.emit(self.held.pop(w))

    def place(self, of, start: int, ids: bytes) -> tuple | None:
        """Place a piece shorter than a window; what no window has room for comes back, if none may be opened."""
        while ids:
            at = bisect_left(self.rooms, (len(ids) // 4,))
            if at < len(self.rooms):
                self._put(at, (of, start, ids))
                return None
            if len(self.rooms) < self.most:
                self.open()
                continue
            if not self.rooms:
                return of, start, ids
            room = self.rooms[0][0]
            self._put(0, (of, start, ids[: 4 * room]))
            start, ids = start + room, ids[4 * room :]
        return None


def merge(windows: list[list], capacity: int) -> Iterator[list]:
    """Full windows from part filled ones, and at last windows whose lengths are powers of two."""
    full: list[list] = []
    into = Windows(capacity, 0, full.append)
    for pieces in windows:
        into.open(pieces)
    rest: list = []
    while into.rooms and not rest:
        _, w = into.rooms.pop()  # the emptiest
        given = into.held.pop(w)
        rest = [left for p in sorted(given, key=lambda p: -len(p[2])) if (left := into.place(*p))]
        yield from full
        full.clear()
    # only one window's pieces can be left: all others are full
    left = sum(len(p[2]) for p in rest) // 4
    while left:
        size = want = 1 << left.bit_length() - 1
        out = []
        while want:
            of, start, ids = rest.pop()
            n = min(want, len(ids) // 4)
            out.append((of, start, ids[: 4 * n]))
            if 4 * n < len(ids):
                rest.append((of, start + n, ids[4 * n :]))
            want -= n
        left -= size
        yield out


class _Rows:
    """Placed pieces as columns, in the order of the result."""

    def __init__(self, id_col: str, kind: pa.DataType):
        self.id_col, self.kind = id_col, kind
        self.columns: tuple[list, ...] = ([], [], [], [], [], [], [])

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, sequence: int, pieces: list) -> None:
        offset = 0
        for (doc, tokens), start, ids in pieces:
            for column, v in zip(self.columns, (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset), strict=True):
                column.append(v)
            offset += len(ids) // 4

    def take(self, ids: list | None = None) -> pa.RecordBatch:
        names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        docs, *rest = self.columns
        more = {} if ids is None else {"ids": pa.array(ids or [None] * len(docs), pa.binary())}
        batch = record_batch(**{self.id_col: pa.array(docs, self.kind)}, **{n: pa.array(v, pa.int64()) for n, v in zip(names, rest, strict=True)}, **more)
        self.columns = ([], [], [], [], [], [], [])
        return batch


_encoders: dict[str, Encoder] = {}


def pack_windows(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, open_windows: int = OPEN, group: int = GROUP) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece. ``tokenizer``: path of its file."""
    kind, arrow = df.schema[id_col].dataType.simpleString(), to_arrow_type(df.schema[id_col].dataType)
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder, part = _encoders[tokenizer], TaskContext.get().partitionId()
        rows, made = _Rows(id_col, arrow), 0

        def emit(pieces):
            nonlocal made
            rows.add((part << 32) + made, pieces)
            made += 1

        windows = Windows(capacity, open_windows, emit)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + tail if text else tail
                of, whole = (doc, len(ids) // 4), len(ids) // (4 * capacity) * capacity
                for start in range(0, whole, capacity):
                    emit([(of, start, ids[4 * start : 4 * (start + capacity)])])
                windows.place(of, whole, ids[4 * whole :])
            if len(rows):
                yield rows.take([])
        ids = []
        for w, pieces in windows.held.items():  # the number only tells open windows apart
            rows.add(w, pieces)
            ids += [p[2] for p in pieces]
        if ids:
            yield rows.take(ids)

    # one tokenising pass, kept: the emitted windows and the open ones are both read from it
    placed = cut(df.select(id_col, text_col).mapInArrow(run, f"{schema}, ids binary").withColumn("part", F.spark_partition_id()))
    done = placed.where("ids is null").drop("ids", "part")

    def join(key, table):
        table = table.take(pc.sort_indices(table, [("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]))
        windows: dict[tuple, list] = {}
        columns = (table.column(c).to_pylist() for c in ("part", "sequence_id", id_col, "doc_tokens", "start", "ids"))
        for part, w, doc, tokens, start, ids in zip(*columns, strict=True):
            windows.setdefault((part, w), []).append(((doc, tokens), start, ids))
        rows = _Rows(id_col, arrow)
        for made, pieces in enumerate(merge(list(windows.values()), capacity)):
            rows.add(-1 - ((key[0].as_py() << 32) + made), pieces)
        return pa.Table.from_batches([rows.take()])

    left = placed.where("ids is not null").withColumn("group", F.col("part").cast("bigint"))
    left = left.withColumn("group", F.floor(F.col("group") / group))
    merged = left.groupBy("group").applyInArrow(join, schema)
    return done.union(merged)
