"""Pages to hOCR: components, lines, cut-outs sent to a recognition service, texts dealt to words, markup.

Detection and line grouping run where the image is; the lines of an image are asked for together, as many at once as
``calls`` says.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources import providers as P
from . import hocr
from .layout import LINE_BAND, MERGE_BAND, PADDING, components, gray_levels, stretch


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray picture."""
    height, width = gray.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = gray
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def cut_out(gray: np.ndarray, box: tuple[int, int, int, int], padding: int = PADDING) -> np.ndarray:
    x, y, w, h = box
    left, top = max(0, x - padding), max(0, y - padding)
    return gray[top : top + h + 2 * padding, left : left + w + 2 * padding]


def reading_order(boxes: list[tuple[int, int, int, int]], band: int | None) -> list[tuple[int, int, int, int]]:
    """By bands: in order of y a band ends where y is ``band``, or else half its height, or more below the box before; a band is read by x."""
    number, last, ordered = 0, None, []
    for box in sorted(boxes, key=lambda b: (b[1], b[0], b[2], b[3])):
        number += last is not None and box[1] - last[1] >= (last[3] // 2 if band is None else band)
        last = box
        ordered.append((number, *box))
    return [b[1:] for b in sorted(ordered)]


def envelope(boxes: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int]:
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y


def words_of(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Components that go on each other become words."""
    groups: list[list] = []
    for b in reading_order(parts, MERGE_BAND):
        a = groups[-1][-1] if groups else None
        if a and 0 <= b[0] - (a[0] + a[2]) <= max(a[3], b[3]) // 3 and b[1] + b[3] >= a[1] and b[1] <= a[1] + a[3]:
            groups[-1].append(b)
        else:
            groups.append([b])
    return [envelope(g) for g in groups]


def folded(words: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Envelopes of words that overlap a line's growing envelope, stretched by a third of its mean height: as :func:`~.layout.fold_lines`."""
    lines: list[list] = []
    for b in reading_order(words, None):
        if lines:
            x, y, w, h = envelope(lines[-1])
            slack = sum(m[3] for m in lines[-1]) // len(lines[-1]) // 3
            if b[1] + b[3] >= y - slack and b[1] <= y + h + slack:
                lines[-1].append(b)
                continue
        lines.append([b])
    return [envelope(m) for m in lines]


def lines_of(words: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    lines: list[list] = []
    for b in reading_order(words, LINE_BAND):
        if lines and abs(b[1] - lines[-1][-1][1]) < LINE_BAND:
            lines[-1].append(b)
        else:
            lines.append([b])
    return lines


def transcribe_pages(images: DataFrame, make: Callable[[], P.Client], model: str, temperature: float = 0.0, calls: P.Calls = P.Calls()) -> DataFrame:
    """(page, number, x, y, w, h, text) for the text lines found in images (rows of ``spark.read.format("image")``).

    Words are grouped to lines by the growing envelope; line boxes side by side are asked for together, and their text is dealt to them.

    If that call fails each box is asked for by itself; one that can't be read has text ''.
    """
    rows = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = P.Caller(make, calls)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                gray = gray_levels(r.data, r.height, r.width, r.nChannels)
                ask = lambda box, gray=gray: P.Request(model, P.LINE_PROMPT, P.Image(png(cut_out(gray, box)), "image/png"), temperature)
                said = lambda line, ask=ask: P.transcribe_line(client, ask(envelope(line)), [ask(b) for b in line])
                lines = lines_of(folded(words_of(components(stretch(gray)))))
                texts = [(box, text) for line, dealt in zip(lines, client.each(said, lines), strict=True) for box, text in zip(line, dealt, strict=True)]
                out += [(r.origin, number, *box, text) for number, (box, text) in enumerate(texts, 1)]
            yield pd.DataFrame(out, columns=["page", "number", "x", "y", "w", "h", "text"])

    return rows.mapInPandas(run, "page string, number int, x int, y int, w int, h int, text string")


def transcribed_hocr(images: DataFrame, make: Callable[[], P.Client], model: str, temperature: float = 0.0, strict: bool = False) -> DataFrame:
    """(page, hocr) of each image that has words."""
    return hocr.pages(transcribe_pages(images, make, model, temperature), strict=strict)
