"""Best-fit packing with a swap-based local search.

A document's tokens and one end token are cut into pieces of at most ``capacity``; full pieces are sequences of their
own. The others are dealt to shards of about ``SHARD`` pieces, each packed by one task: best fit in decreasing order,
then a local search over the bins that aren't full. It moves a piece, or exchanges one piece for one, or two for
one, where that raises the sum of squared fills, until bins are empty and no step helps.
A shard leaves at most a few bins part empty, against thousands filled, so shards cost nothing to speak of.

Null text is empty text: one piece with the end token alone. Rows are packed as they are, repeated ones too; ids may be null
or repeated. No rows: no pieces. The result has the id and the named columns alone, so other columns don't matter. Among
pieces of equal length the smaller id goes first.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import cut, map_batches, record_batch

CAPACITY = 4096
END = 1
SHARD = 32768
#: Shares of the bins that give in a round, one after the other.
SHARES = (0.1, 0.5, 0.9, 0.002, 0.3, 0.7, 0.02, 0.98)
#: Words whose token ids a worker keeps; more are forgotten and looked up anew.
WORDS_KEPT = 500_000
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f\xad]|<\\|")
# The tokenizer's split pattern, and how its file says that texts are prepared.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_RUNS = regex.compile(_SPLIT)


def _byte_marks() -> list[str]:
    """Byte-level form: printable bytes stand for themselves, the others for the characters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    marks, more = [], 256
    for b in range(256):
        marks.append(chr(b if b in shown else more))
        more += b not in shown
    return marks


_BYTE_MARKS = _byte_marks()


class Encoder:
    """The tokenizer's ids as little-endian bytes, from words seen before.

    The pre-tokenizer drops white space and never joins across it, so a text's ids are those of its words, and a word's
    those of its runs of letters, digits and marks. In Latin-1 text composition changes nothing and lower-casing goes
    character by character, so words are lower-cased and split here and only new runs reach the tokenizer's merges.
    Any other text, one with a special token's mark or with separators that only Python splits at, is
    encoded as a whole, and so is every text for a tokenizer that doesn't prepare texts in this way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        own = form["model"].get("type", "BPE") == "BPE" and not form["model"].get("ignore_merges")
        self.known_form = own and all(form.get(k) == v for k, v in _FORM.items()) and all(t["special"] for t in form["added_tokens"])
        self.merge = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            marks = run if run.isascii() else "".join(map(_BYTE_MARKS.__getitem__, run.encode()))
            ids = self.runs[run] = array("I", [t.id for t in self.merge(marks)]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if not self.known_form:
            return self._plain(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._plain(text)
        if _ODD.search(text):
            return self._plain(text)
        known, words = self.words, text.split()
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
                self.runs.clear()
            for w in words:
                if w not in known:
                    low = w.lower()
                    known[w] = self._run(low) if low.isalpha() else b"".join(map(self._run, _RUNS.findall(low)))
            return b"".join(map(known.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each row. ``tokenizer``: path of its file."""
    kind = df.schema[id_col].dataType.simpleString()
    tail = np.array([end], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = encoder.encode(text or "") + tail
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return record_batch(**{id_col: pc.take(batch.column(0), pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), **{n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("ids_crc32", crc))}})

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Bins:
    """Open bins by free room, as a bitmap of rooms in use and a stack for each."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, b: int, room: int) -> None:
        self.by_room[room].append(b)
        self.rooms |= 1 << room

    def best(self, size: int) -> int | None:
        """Take the bin with the least room that still holds ``size``."""
        fit = self.rooms >> size
        if not fit:
            return None
        room = size + (fit & -fit).bit_length() - 1
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        return b


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: best fit, longest first."""
    bins: list[list[int]] = []
    room: list[int] = []
    open_bins = _Bins(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = open_bins.best(lengths[i])
        if b is None:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] -= lengths[i]
        open_bins.put(b, room[b])
    return bins


def _pairs(held: list[int], size: list[int]) -> list[tuple[int, int]]:
    """Pairs of a bin's pieces, one for each two lengths: no other pair of these could do more.

    A bin has few different lengths (at most 90 of sum 4096), so there are few pairs whatever the number of pieces.
    """
    of: dict[int, list[int]] = {}
    for i in held:
        own = of.setdefault(size[i], [])
        if len(own) < 2:
            own.append(i)
    some = [i for own in of.values() for i in own]
    seen, out = set(), []
    for k, i in enumerate(some):
        for j in some[k + 1 :]:
            if (both := size[i] + size[j]) not in seen:
                seen.add(both)
                out.append((i, j))
    return out


class _Index:
    """Pieces and pairs of pieces of the bins that give, by length and then from the fuller to the emptier bin."""

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: list[int]):
        self.bins, self.fill, self.lengths = bins, fill, lengths
        self.single: list[tuple] = []
        self.double: list[tuple] = []

    def _entries(self, b: int) -> tuple[list, list]:
        held, size, back = self.bins[b], self.lengths, -self.fill[b]
        double = [(size[i] + size[j], back, b, (i, j)) for i, j in _pairs(held, size)]
        return [(size[i], back, b, (i,)) for i in held], double

    def fill_in(self, some: list[int]) -> None:
        for b in some:
            for to, entries in zip((self.single, self.double), self._entries(b), strict=True):
                to += entries
        self.single.sort()
        self.double.sort()

    def add(self, b: int) -> None:
        for to, entries in zip((self.single, self.double), self._entries(b), strict=True):
            for e in entries:
                insort(to, e)

    def drop(self, b: int) -> None:
        for to, entries in zip((self.single, self.double), self._entries(b), strict=True):
            for e in entries:
                del to[bisect_left(to, e)]

    @staticmethod
    def find(entries: list[tuple], above: int, most: int) -> tuple | None:
        """The longest entry over ``above`` and up to ``most``, of the emptiest bin among those."""
        k = bisect_left(entries, (most + 1,)) - 1
        return entries[k] if k >= 0 and entries[k][0] > above else None

    def step(self, target: int, capacity: int) -> tuple | None:
        """(gives, its bin, takes back): the exchange that raises the squared fills of ``target`` and a bin that gives most."""
        held, size, full = self.bins[target], self.lengths, self.fill[target]
        room, best, most = capacity - full, None, 0
        backs = [(), *((i,) for i in held), *_pairs(held, size)]
        for back in backs:
            own = sum(size[i] for i in back)
            # a move or one for one or two, two for one
            for entries in (self.single, self.double)[: 2 if len(back) == 1 else 1]:
                e = self.find(entries, own, own + room)
                if e and (gain := (e[0] - own) * (full + e[1] + e[0] - own)) > most:
                    best, most = (e[3], e[2], back), gain
        return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins by steps that raise the sum of squared fills: the fuller bin of a pair always gains.

    A step moves a piece, exchanges it for a shorter one, or exchanges two for one, either way. In a round the emptier bins give to
    the fuller ones, every bin that isn't full being one or the other; partners are found by an index of the givers' lengths. Where no share
    of givers helps any more, or the bins are as few as their contents need, the search ends.
    """
    bins = [list(b) for b in bins if b]
    fill = [sum(lengths[i] for i in b) for b in bins]
    least, left = -(-sum(fill) // capacity), len(bins)
    share, idle = 0, 0
    while left > least and idle < len(SHARES):
        open_bins = sorted((b for b, n in enumerate(fill) if 0 < n < capacity), key=lambda b: (fill[b], b))
        give = max(1, int(len(open_bins) * SHARES[share]))
        index = _Index(bins, fill, lengths)
        index.fill_in(open_bins[:give])
        helped = False
        for target in reversed(open_bins[give:]):
            while fill[target] < capacity and left > least and (step := index.step(target, capacity)):
                gives, source, back = step
                index.drop(source)
                for b, gone, come in ((target, back, gives), (source, gives, back)):
                    bins[b] = [i for i in bins[b] if i not in gone] + list(come)
                    fill[b] = sum(lengths[i] for i in bins[b])
                index.add(source)
                left -= not bins[source]
                helped = True
        idle = 0 if helped else idle + 1
        share = share if helped else (share + 1) % len(SHARES)
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, shard: int = SHARD) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    A shard's task holds its pieces' rows (under 100 bytes each), whatever the input's size; the number of shards follows
    the number of pieces. Shards are dealt by a hash of the piece, so equal ids don't meet in one shard by design.
    """
    cut_up = cut(pieces(df, tokenizer, id_col, text_col, capacity, end))
    n = cut_up.where(F.col("length") < capacity).count()
    shards = max(1, -(-n // shard))
    key = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", F.spark_partition_id()), F.lit(shards))
    schema = f"{cut_up.schema.simpleString()[7:-1]}, sequence_id bigint, offset bigint"

    def run(key, rows):
        rows = rows.drop_columns(["shard"])
        order = pc.sort_indices(rows, [("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        rows = rows.take(order)
        lengths = rows.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for b, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (key[0].as_py() << 32) + b, at
                at += lengths[i]
        return rows.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    part = cut_up.where(F.col("length") < capacity).withColumn("shard", key).groupBy("shard").applyInArrow(run, schema)
    full = cut_up.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return part.union(full)
