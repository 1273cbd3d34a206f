"""Quoted CSV files read by byte ranges, with their rows numbered.

Spark splits a file at line breaks wherever a range ends, but a line break inside of quotes ends no row. So the file is read twice. The first
time each range tells, for either state that it may begin in (between rows, or inside of quotes), the state that it ends in. These
functions are composed in the order of the ranges, by windows over one row for each range. The second time each range,
now knowing its state, parses the rows that lie inside of it and hands over the rest in pieces; the pieces of a row
that crosses ranges meet by the range in which it begins. Numbers are sums of what the ranges before have.

What a file's rows are is what Python's strict ``csv`` reader says.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import cut

#: Ranges up to which their states are broadcast, some 100 bytes each; beyond that, lines are shuffled to them.
RANGES = 100_000
#: Lines parsed at a time.
LINES = 5000
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r]*+|[^",\r][^,\r]*+|)'
_FIELDS = re.compile(rf"(?:{_FIELD}[,\r])*+")
_OPEN = re.compile(r'"[^"]*+(?:""[^"]*+)*+')
_ROW = "file string, block bigint, span int, k bigint, fields array<string>, since bigint, piece string, error string"


def _opens(line: str) -> bool:
    """Whether a line that begins a row ends inside of quotes."""
    return _OPEN.fullmatch(line, _FIELDS.match(line).end()) is not None


def _after(state: bool, line: str) -> bool:
    return _opens(f'"{line}' if state else line) if '"' in line else state


def parsed(text: str) -> list[list[str]]:
    """The rows of a text, blank lines left out. A cell may be of any length."""
    csv.field_size_limit(sys.maxsize)
    return [r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if r]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _states(batches):
    """(file, block, from_row, from_quotes, closes): the state at the end of a range for either start; whether quotes end in it if it begins inside of them."""
    at, ends, closes = None, [False, True], False
    done: list[tuple] = []
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        quoted = pc.match_substring(batch.column(2), '"').to_pylist()
        values = batch.column(2)
        for i, here in enumerate(zip(files, blocks, strict=True)):
            if here != at:
                if at:
                    done.append((*at, *ends, closes))
                at, ends, closes = here, [False, True], False
            if quoted[i]:
                line = values[i].as_py().decode("utf-8", "replace")
                ends = [_after(s, line) for s in ends]
            closes |= not ends[1]
        if done:
            yield _batch(done)
            done = []
    if at:
        yield _batch([(*at, *ends, closes)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, block, a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"file": file, "block": pa.array(block, pa.int64()), "from_row": a, "from_quotes": b, "closes": c})


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside, since): whether a range begins inside of quotes, and in which range that row began.

    A range's function is the identity, a swap or a constant: the state is the last constant's, flipped by the swaps since.
    """
    ranges = lines.mapInArrow(_states, "file string, block bigint, from_row boolean, from_quotes boolean, closes boolean")
    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("swaps", F.sum((F.col("from_row") & ~F.col("from_quotes")).cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("from_row") == F.col("from_quotes"), F.struct(F.col("from_row").cast("int").alias("state"), "swaps"))
    ranges = ranges.withColumns({"last": F.last(fixed, True).over(before), "flips": F.coalesce(F.lag("swaps").over(upto), F.lit(0))})
    inside = (F.coalesce("last.state", F.lit(0)) + F.col("flips") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    ranges = ranges.withColumn("inside", inside)
    begins = F.when(~F.col("inside") | F.col("closes"), F.col("block"))
    return cut(ranges.withColumn("since", F.last(begins, True).over(before)).select("file", "block", "inside", "since"))


class _Range:
    """The rows and pieces of one range."""

    def __init__(self, file: str, block: int, inside: bool, since: int | None):
        self.at, self.state, self.since = (file, block), inside, since
        self.head: list[str] | None = [] if inside else None
        self.waiting: list[str] = []
        self.closed = self.k = 0
        self.broken = False

    def row(self, **given) -> dict:
        return {"file": self.at[0], "block": self.at[1], "span": None, "k": None, "fields": None, "since": None, "piece": None, "error": None} | given

    def parse(self):
        """The rows of the waiting lines up to the last that ends one."""
        lines, self.waiting, self.closed = self.waiting[: self.closed], self.waiting[self.closed :], 0
        if not lines or self.broken:
            return
        try:
            for fields in parsed("\n".join(lines) + "\n"):
                yield self.row(span=1, k=self.k, fields=fields)
                self.k += 1
        except csv.Error as e:
            self.broken = True
            yield self.row(span=1, error=str(e))

    def add(self, line: str):
        self.state = _after(self.state, line)
        if self.head is not None:
            self.head.append(line)
            if not self.state:
                yield self.row(since=self.since, piece="\n".join(self.head) + "\n")
                self.head = None
            return
        self.waiting.append(line)
        if not self.state:
            self.closed = len(self.waiting)
            if self.closed >= LINES:
                yield from self.parse()

    def end(self):
        yield from self.parse()
        if self.head is not None:
            yield self.row(since=self.since, piece="\n".join(self.head) + "\n")
        elif self.waiting and not self.broken:
            yield self.row(since=self.at[1], piece="\n".join(self.waiting) + "\n")


_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("span", pa.int32()), ("k", pa.int64()), ("fields", pa.list_(pa.string())), ("since", pa.int64()), ("piece", pa.string()), ("error", pa.string())])


def _rows_of(batches):
    """Rows and pieces of ranges, whose lines follow each other."""
    now = None
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "inside", "since", "value"))
        for (file, block), same in groupby(zip(*columns, strict=True), key=lambda r: r[:2]):
            for _, _, inside, since, value in same:
                if now is None or now.at != (file, block):
                    out += now.end() if now else []
                    now = _Range(file, block, inside, since)
                out += now.add(value.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
    if now:
        yield pa.RecordBatch.from_pylist(list(now.end()), schema=_ARROW)


def _joined_rows(batches):
    """Rows of pieces put together."""
    for batch in batches:
        out = []
        for file, block, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "text")), strict=True):
            none = {"file": file, "block": block, "span": 0, "k": None, "fields": None, "since": None, "piece": None, "error": None}
            try:
                out += [none | {"k": k, "fields": r} for k, r in enumerate(parsed(text))]
            except csv.Error as e:
                out.append(none | {"error": str(e)})
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def scan_csv(spark: SparkSession, path: str, sentinel: str, ranges: int = RANGES) -> DataFrame:
    """(file, row_idx, fields, error) of each CSV file at ``path``; a first row that begins with ``sentinel``, in whatever case, is a header and isn't counted.

    A file without a row, with rows of different lengths or with broken quotes gives one row with ``error`` alone.
    A row that crosses ranges is put together by one task.
    """
    lines = _lines(spark, path)
    starts = _starts(lines)
    if few := starts.count() <= ranges:
        known = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        known = lines.withColumn("n", F.monotonically_increasing_id()).join(starts, ["file", "block"])
        known = known.repartition("file", "block").sortWithinPartitions("file", "block", "n")
    found = cut(known.select("file", "block", "inside", "since", "value").mapInArrow(_rows_of, _ROW))
    pieces = found.where("piece is not null").groupBy("file", "since").agg(F.max("block").alias("block"), F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("pieces"))
    crossing = pieces.select("file", "block", F.array_join("pieces.piece", "").alias("text")).mapInArrow(_joined_rows, _ROW)
    rows = found.where("piece is null").union(crossing)

    order = Window.partitionBy("file").orderBy("block", "span").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("error").isNull()
    parts = rows.groupBy("file", "block", "span").agg(
        F.count(F.when(good, 1)).alias("n"), F.min(F.size("fields")).alias("low"), F.max(F.size("fields")).alias("high"),
        F.min_by(F.get("fields", F.lit(0)), "k").alias("first"), F.first("error", True).alias("error"),
    ).withColumn("offset", F.coalesce(F.sum("n").over(order), F.lit(0)))
    parts = cut(parts)
    place = F.struct("block", "span")
    header = F.lower(F.trim(F.min_by(F.when(F.col("n") > 0, F.col("first")), F.when(F.col("n") > 0, place)))) == sentinel.lower()
    files = parts.groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min_by("error", F.when(F.col("error").isNotNull(), place)).alias("broken"), F.coalesce(header, F.lit(False)).cast("int").alias("header"))
    files = starts.select("file").distinct().join(files, "file", "left")
    error = F.coalesce("broken", F.when(F.col("low").isNull(), "the manifest is empty"), F.when(F.col("low") != F.col("high"), "wrong number of fields"))
    files = files.select("file", "header", error.alias("error"))
    places = parts.select("file", "block", "span", "offset").join(files.where("error is null").select("file", "header"), "file")
    numbered = rows.where(good).join(F.broadcast(places) if few else places, ["file", "block", "span"])
    numbered = numbered.select("file", (F.col("offset") + F.col("k") - F.col("header")).alias("row_idx"), "fields", F.lit(None).cast("string").alias("error")).where("row_idx >= 0")
    return numbered.union(files.where("error is not null").select("file", F.lit(None).cast("bigint"), F.lit(None).cast("array<string>"), "error"))
