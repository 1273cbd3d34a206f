"""Page layout: boxes filtered, ordered, merged to words, grouped to lines; text dealt to word slots.

Boxes are rows (page, x, y, w, h). Order within a page is by bands: in order of y a new band begins where y is ``band`` or
more below the box before, and a band is read by x. Every window is over one page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import let, tokenize
from ..sources.shared import cut

MERGE_BAND = 10
LINE_BAND = 20
PADDING = 10


def is_text_pixel(r: Column, g: Column, b: Column) -> Column:
    """Dark on 8-bit channels."""
    return F.floor((r + g + b) * 257 / 3) < 32768


def valid_word_size(w: Column, h: Column, width: Column, height: Column) -> Column:
    half, fifth = F.floor(width / 2), F.floor(height / 5)
    return (w >= 8) & (h >= 10) & (w <= half) & (h <= fifth)


def _before(page: str, *order) -> Window:
    return Window.partitionBy(page).orderBy(*order)


def in_bands(boxes: DataFrame, page: str = "page", band: int | None = MERGE_BAND) -> DataFrame:
    """``boxes`` with ``band`` and ``pos`` (from 1) of each within its page. Ties go by x, y, size.

    Without a size, a band ends half the height of the box before below it.
    """
    by_y = _before(page, "y", "x", "w", "h")
    size = F.lit(band) if band is not None else F.floor(F.lag("h").over(by_y) / 2)
    start = F.coalesce((F.col("y") - F.lag("y").over(by_y) >= size).cast("int"), F.lit(0))
    rows = boxes.withColumn("__start", start)
    rows = rows.withColumn("band", F.sum("__start").over(by_y.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")
    return rows.withColumn("pos", F.row_number().over(_before(page, "band", "x", "y", "w", "h")))


def should_merge(x0: Column, y0: Column, w0: Column, h0: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The second box goes on the first: a gap from 0 to a third of the taller one, and vertical overlap."""
    gap = x - (x0 + w0)
    return (gap >= 0) & (gap <= F.floor(F.greatest(h0, h) / 3)) & (y + h >= y0) & (y <= y0 + h0)


def envelope(group) -> list[Column]:
    """Aggregates of a group's box."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return [F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"), F.count("*").alias("n")]


def merge_words(boxes: DataFrame, page: str = "page") -> DataFrame:
    """(page, word, x, y, w, h, n): runs of boxes that go on each other become one."""
    rows = in_bands(boxes, page)
    w = _before(page, "pos")
    last = [F.lag(c).over(w) for c in ("x", "y", "w", "h")]
    joined = should_merge(*last, *[F.col(c) for c in ("x", "y", "w", "h")])
    rows = rows.withColumn("__new", F.when(joined, 0).otherwise(1))
    rows = rows.withColumn("word", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(page, "word").agg(*envelope("word"))


def line_runs(boxes: DataFrame, page: str = "page", band: int = LINE_BAND) -> DataFrame:
    """``boxes`` with ``line`` (from 1): a new line begins where y is ``band`` or more away from the word before."""
    rows = in_bands(boxes, page, band)
    w = _before(page, "pos")
    far = F.coalesce((F.abs(F.col("y") - F.lag("y").over(w)) >= band).cast("int"), F.lit(1))
    return rows.withColumn("__new", far).withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


class _Line:
    """A line while words may still join it."""

    def __init__(self, number: int, x: int, y: int, w: int, h: int):
        self.number, self.left, self.top, self.right, self.bottom = number, x, y, x + w, y + h
        self.heights, self.words = h, [(x, y, w, h)]

    def takes(self, y: int, h: int) -> bool:
        slack = self.heights // len(self.words) // 3
        return y + h >= self.top - slack and y <= self.bottom + slack

    def add(self, x: int, y: int, w: int, h: int) -> None:
        self.left, self.top = min(self.left, x), min(self.top, y)
        self.right, self.bottom = max(self.right, x + w), max(self.bottom, y + h)
        self.heights += h
        self.words.append((x, y, w, h))


def fold_lines(boxes: DataFrame, page: str = "page", words: bool = False) -> DataFrame:
    """(page, line, x, y, w, h, n): a word joins the line while it overlaps the line's growing envelope.

    ``words`` adds the line's own boxes, in order, as an array.

    The envelope is stretched by a third of the line's mean height. The state depends on all words before, so this is a fold, which
    windows can't express: tasks go once over their pages' boxes in order, hold the line that is open, and emit it when it closes.
    """
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("x", "y", "w", "h")]
    # the windows have brought each page together
    ordered = in_bands(boxes, page, None).select(F.col(page), "pos", *numbers).sortWithinPartitions(page, "pos")
    kind = boxes.schema[page].dataType
    arrow = to_arrow_type(kind)
    item = pa.list_(pa.struct([(c, pa.int64()) for c in ("x", "y", "w", "h")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, done = None, None, []

        def emitted() -> pa.RecordBatch:
            lines = [x for _, x in done]
            columns = [pa.array([p for p, _ in done], arrow), pa.array([x.number for x in lines], pa.int32())]
            columns += [pa.array(v, pa.int64()) for v in ([x.left for x in lines], [x.top for x in lines], [x.right - x.left for x in lines], [x.bottom - x.top for x in lines], [len(x.words) for x in lines])]
            if words:
                columns.append(pa.array([[dict(zip("xywh", b, strict=True)) for b in x.words] for x in lines], item))
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[page, "line", "x", "y", "w", "h", "n", "words"][: len(columns)])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5))
            for p, *box in zip(*columns, strict=True):
                if line is None or p != at:
                    if line:
                        done.append((at, line))
                    at, line = p, _Line(1, *box)
                elif line.takes(box[1], box[3]):
                    line.add(*box)
                else:
                    done.append((at, line))
                    line = _Line(line.number + 1, *box)
            if done:
                yield emitted()
        if line:
            done.append((at, line))
            yield emitted()

    schema = f"`{page}` {kind.simpleString()}, line int, x bigint, y bigint, w bigint, h bigint, n bigint"
    if not words:
        return ordered.mapInArrow(run, schema)
    found = ordered.mapInArrow(run, f"{schema}, words array<struct<x: bigint, y: bigint, w: bigint, h: bigint>>")
    own = ", ".join(f"{c}: {boxes.schema[c].dataType.simpleString()}" for c in ("x", "y", "w", "h"))
    return found.withColumn("words", F.col("words").cast(f"array<struct<{own}>>"))


def crop(x: Column, y: Column, w: Column, h: Column, padding: int = PADDING) -> Column:
    """struct(x, y, w, h) of a padded cut-out; null for an empty box."""
    cut = F.struct(F.greatest(F.lit(0), x - padding).alias("x"), F.greatest(F.lit(0), y - padding).alias("y"), (w + 2 * padding).alias("w"), (h + 2 * padding).alias("h"))
    return F.when((w > 0) & (h > 0), cut)


def distribute_words(text: Column, slots: Column) -> Column:
    """The text's words dealt to ``slots`` in order, the first ones taking one more if they don't divide; spare slots get ''."""

    def dealt(words: Column) -> Column:
        share, more = F.floor(F.size(words) / slots).cast("int"), F.pmod(F.size(words), slots)

        def slot(i: Column) -> Column:
            return F.array_join(F.slice(words, i * share + F.least(i, more) + 1, share + (i < more).cast("int")), " ")

        return F.transform(F.sequence(F.lit(0), F.greatest(slots, F.lit(1)) - 1), slot)

    return F.when(slots > 0, let(tokenize(text), dealt)).otherwise(F.array().cast("array<string>"))


DARK = 32768 / 257


def _labelled(gray: np.ndarray, limit: float = DARK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and first column, row and end column, label) of each run of dark pixels, by rows; 8-connected runs share a label.

    Two-pass labelling over runs, so a large region costs memory for its runs, not a call for each pixel. A label is its first run's number.
    """
    height = gray.shape[0]
    dark = np.pad((gray < limit).astype(np.int8), ((0, 0), (1, 1)))
    edges = np.diff(dark, axis=1)
    starts, stops = np.argwhere(edges == 1), np.argwhere(edges == -1)
    parent = list(range(len(starts)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    row_of = np.searchsorted(starts[:, 0], np.arange(height + 1))
    for y in range(1, height):
        i, j = int(row_of[y - 1]), int(row_of[y])
        last_i, last_j = j, int(row_of[y + 1])
        while i < last_i and j < last_j:
            if starts[i, 1] <= stops[j, 1] and starts[j, 1] <= stops[i, 1]:  # runs that touch, corners too
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if stops[i, 1] < stops[j, 1]:
                i += 1
            else:
                j += 1
    return starts, stops, np.array([root(k) for k in range(len(starts))], np.int64)


def _envelopes(starts: np.ndarray, stops: np.ndarray, labels: np.ndarray) -> dict[int, list[int]]:
    """[left, top, right, bottom] of each label, ends excluded, in order of the first runs."""
    boxes: dict[int, list[int]] = {}
    for (y, x0), x1, k in zip(starts.tolist(), stops[:, 1].tolist(), labels.tolist(), strict=True):
        box = boxes.setdefault(k, [x0, y, x1, y + 1])
        box[:] = min(box[0], x0), box[1], max(box[2], x1), y + 1
    return boxes


def _word_sized(w: int, h: int, width: int, height: int) -> bool:
    return 8 <= w <= width // 2 and 10 <= h <= height // 5


def components(gray: np.ndarray, limit: float = DARK) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of 8-connected dark regions of word size, in order of their first pixel."""
    height, width = gray.shape
    sized = ((x0, y0, x1 - x0, y1 - y0) for x0, y0, x1, y1 in _envelopes(*_labelled(gray, limit)).values())
    return [b for b in sized if _word_sized(b[2], b[3], width, height)]


def gray_levels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Mean of the colour channels of Spark's image rows."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return pixels[:, :, :3].mean(axis=2) if channels >= 3 else pixels[:, :, 0].astype(float)


def sharpen(gray: np.ndarray) -> np.ndarray:
    """Each pixel moved away from the mean around it (a Gaussian of one pixel), within 0 and 255."""
    weights = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weights /= weights.sum()
    blurred = gray
    for axis in (0, 1):
        padded = np.pad(blurred, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        blurred = sum(w * np.take(padded, np.arange(k, k + gray.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return np.clip(2 * gray - blurred, 0, 255)


def closed(gray: np.ndarray) -> np.ndarray:
    """Morphological closing over two pixels in a row: the larger of neighbours, then the smaller."""
    wide = np.maximum(gray, np.pad(gray, ((0, 0), (0, 1)), mode="edge")[:, 1:])
    return np.minimum(wide, np.pad(wide, ((0, 0), (1, 0)), mode="edge")[:, :-1])


LOW, HIGH, LEVEL = 0.0015, 0.0005, 0.75
#: Rows around a pixel that sharpening looks at.
HALO = 2


def stretch(gray: np.ndarray, low: float = LOW, high: float = HIGH, level: float = LEVEL) -> np.ndarray:
    """Contrast stretch, sharpening, closing and threshold, so that faint writing counts as dark; not pixel-equal to other tools."""
    a, b = np.quantile(gray, [low, 1 - high])
    return _stretched(gray, a, b, level)


def _stretched(gray: np.ndarray, a: float, b: float, level: float = LEVEL) -> np.ndarray:
    if b <= a:
        return np.full(gray.shape, 255.0) if a >= DARK else np.zeros(gray.shape)
    even = np.clip((gray - a) / (b - a), 0, 1) * 255
    return np.where(closed(sharpen(even)) < level * 255, 0.0, 255.0)


def detect_components(images: DataFrame, preprocess: bool = True) -> DataFrame:
    """(path, page_w, page_h, x, y, w, h) of word-sized components of images (rows of ``spark.read.format("image")``)."""
    rows = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                gray = gray_levels(r.data, r.height, r.width, r.nChannels)
                out += [(r.origin, r.width, r.height, *box) for box in components(stretch(gray) if preprocess else gray)]
            yield pd.DataFrame(out, columns=["path", "page_w", "page_h", "x", "y", "w", "h"])

    return rows.mapInPandas(run, "path string, page_w int, page_h int, x int, y int, w int, h int")


def _quantile(values: list[float], counts: list[int], q: float) -> float:
    """As ``np.quantile`` of each value so many times; values ascend."""
    ends = np.cumsum(counts)
    at = q * (int(ends[-1]) - 1)
    k = int(at)
    x, y = (values[int(np.searchsorted(ends, min(i, int(ends[-1]) - 1), side="right"))] for i in (k, k + 1))
    t = at - k
    return y - (y - x) * (1 - t) if t >= 0.5 else x + (y - x) * t


_IMAGE = ["origin", "height", "width", "nChannels"]


def _strips(images: DataFrame, rows: int) -> DataFrame:
    """(origin, height, width, nChannels, strip, above, data): strips of ``rows`` rows and up to ``HALO`` more on either side, ``above`` of them above."""
    sizes = images.select(*[F.col(f"image.{c}").alias(c) for c in (*_IMAGE, "data")])
    n = F.ceil(F.col("height") / rows).cast("int")
    strips = sizes.where("height > 0 and width > 0").withColumn("strip", F.explode(F.sequence(F.lit(0), n - 1)))
    first = F.greatest(F.col("strip") * rows - HALO, F.lit(0))
    last = F.least((F.col("strip") + 1) * rows + HALO, F.col("height"))
    line = F.col("width") * F.col("nChannels")
    data = F.col("data").substr((first * line + 1).cast("int"), ((last - first) * line).cast("int"))
    return strips.select(*_IMAGE, "strip", (F.col("strip") * rows - first).alias("above"), data.alias("data"))


def large_components(images: DataFrame, preprocess: bool = True, rows: int = 512) -> DataFrame:
    """As :func:`detect_components`, for pictures too large for one task: strips of ``rows`` rows are labelled apart.

    A component that touches a strip's edge meets those of the next strip by the runs on either side of the seam; only these components,
    not pixels, are put together by a task for each picture. Contrast is stretched by the whole picture's histogram.
    """
    strips = cut(_strips(images, rows).repartition("origin", "strip"))
    if preprocess:
        strips = strips.join(_contrast(strips, rows), "origin")
    else:
        strips = strips.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    kind = "origin string, width int, height int, strip int, label bigint, x0 int, y0 int, x1 int, y1 int, top array<int>, bottom array<int>"

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                gray = gray_levels(r.data, len(r.data) // (r.width * r.nChannels), r.width, r.nChannels)
                if preprocess:
                    gray = _stretched(gray, r.a, r.b)
                n = min(rows, r.height - r.strip * rows)
                starts, stops, labels = _labelled(gray[r.above : r.above + n])
                sides: dict[int, tuple[list, list]] = {}
                for (y, x0), x1, k in zip(starts.tolist(), stops[:, 1].tolist(), labels.tolist(), strict=True):
                    for side, edge in enumerate((r.strip > 0 and y == 0, (r.strip + 1) * rows < r.height and y == n - 1)):
                        if edge:
                            sides.setdefault(k, ([], []))[side].extend((x0, x1))
                for k, (x0, y0, x1, y1) in _envelopes(starts, stops, labels).items():
                    if k in sides or _word_sized(x1 - x0, y1 - y0, r.width, r.height):
                        top, bottom = sides.get(k, (None, None))
                        out.append((r.origin, r.width, r.height, r.strip, k, x0, y0 + r.strip * rows, x1, y1 + r.strip * rows, top, bottom))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    parts = cut(strips.mapInPandas(label, kind))
    whole = parts.where("top is null").select(F.col("origin").alias("path"), F.col("width").alias("page_w"), F.col("height").alias("page_h"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["strip", "label"], ignore_index=True)
        parent = list(range(len(part)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        sides = [{}, {}]
        for k, (strip, *runs) in enumerate(zip(part["strip"], part["top"], part["bottom"], strict=True)):
            for side, ends in zip(sides, runs, strict=True):
                side.setdefault(strip, []).extend((int(x0), int(x1), k) for x0, x1 in zip(ends[::2], ends[1::2], strict=True))
        for strip, over in sides[1].items():
            over, under = sorted(over), sorted(sides[0].get(strip + 1, []))
            i = j = 0
            while i < len(over) and j < len(under):
                if over[i][0] <= under[j][1] and under[j][0] <= over[i][1]:
                    a, b = root(over[i][2]), root(under[j][2])
                    parent[max(a, b)] = min(a, b)
                if over[i][1] < under[j][1]:
                    i += 1
                else:
                    j += 1
        part["root"] = [root(k) for k in range(len(part))]
        out = part.groupby("root").agg({"origin": "first", "width": "first", "height": "first", "x0": "min", "y0": "min", "x1": "max", "y1": "max"})
        out["x1"], out["y1"] = out["x1"] - out["x0"], out["y1"] - out["y0"]
        return out

    seams = parts.where("top is not null").groupBy("origin").applyInPandas(joined, "origin string, width int, height int, x0 int, y0 int, x1 int, y1 int").toDF("path", "page_w", "page_h", "x", "y", "w", "h")
    return whole.union(seams.where(valid_word_size(F.col("w"), F.col("h"), F.col("page_w"), F.col("page_h"))))


def _contrast(strips: DataFrame, rows: int) -> DataFrame:
    """(origin, a, b): the gray levels between which each picture is stretched."""

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                pixels = np.frombuffer(r.data, np.uint8).reshape(-1, r.width, r.nChannels)
                pixels = pixels[r.above : r.above + min(rows, r.height - r.strip * rows)]
                counts = np.bincount(pixels[:, :, :3].sum(axis=2, dtype=np.int64).ravel() if r.nChannels >= 3 else pixels[:, :, 0].ravel())
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"origin": r.origin, "level": some, "n": counts[some], "shares": 3 if r.nChannels >= 3 else 1})

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for origin, shares, pairs in zip(batch["origin"], batch["shares"], batch["pairs"], strict=True):
                values, counts = [p["level"] / shares for p in pairs], [p["n"] for p in pairs]
                out.append((origin, _quantile(values, counts, LOW), _quantile(values, counts, 1 - HIGH)))
            yield pd.DataFrame(out, columns=["origin", "a", "b"])

    counted = strips.mapInPandas(levels, "origin string, level int, n bigint, shares int").groupBy("origin", "shares", "level").agg(F.sum("n").alias("n"))
    pairs = counted.groupBy("origin", "shares").agg(F.sort_array(F.collect_list(F.struct("level", "n"))).alias("pairs"))
    return pairs.mapInPandas(bounds, "origin string, a double, b double")
