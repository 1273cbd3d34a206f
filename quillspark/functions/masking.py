"""Ignore patterns: marks in a reference for what couldn't be read.

A mark that stands alone between white space stands for a word of the hypothesis, one inside a word for a character.
The walk is by position, so marks are found with one split of the reference, and a fold over the pieces moves a
cursor through the hypothesis.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import WS


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in literal)


def ignored_count(ref: Column, patterns: list[str]) -> Column:
    """Characters of all occurrences, counted for each pattern by itself."""
    lost = (F.length(ref) - F.length(F.replace(ref, F.lit(p), F.lit(""))) for p in patterns if p)
    return reduce(lambda a, b: a + b, lost, F.lit(0)).cast("int")


def mask(ref: Column, hyp: Column, patterns: list[str]) -> Column:
    """struct(ref, hyp, ignored). Without patterns both texts stay; with any, the hypothesis ends where the reference does."""
    if not patterns:
        return F.struct(ref.alias("ref"), hyp.alias("hyp"), F.lit(0).alias("ignored"))
    real = [p for p in patterns if p]
    if real:
        any_mark = "|".join(map(_quoted, real))
        pieces, marks = F.split(ref, any_mark, -1), F.regexp_extract_all(ref, F.lit(any_mark), F.lit(0))
        left = F.array_join(pieces, "")
    else:
        pieces, marks, left = F.array(ref), F.array().cast("array<string>"), ref

    def step(state: Column, cut: Column) -> Column:
        piece, mark = cut.piece, cut.mark
        size = F.length(piece)
        taken = F.concat(state.out, F.substring(hyp, state.j + 1, size))
        at = F.least(state.j + size, F.length(hyp))
        end = state.p + size
        alone = F.substring(ref, end, F.lit(1)).rlike(f"^[{WS}]?\\z") & F.substring(ref, end + F.length(mark) + 1, F.lit(1)).rlike(f"^[{WS}]?\\z")
        alone = alone | ((end == 0) & F.substring(ref, F.length(mark) + 1, F.lit(1)).rlike(f"^[{WS}]?\\z"))
        word = F.length(F.regexp_extract(F.substring(hyp, at + 1, F.length(hyp)), f"^[{WS}]*[^{WS}]*", 0))
        moved = F.when(mark == "", at).when(alone, at + word).otherwise(at + 1)
        return F.struct((end + F.length(mark)).alias("p"), F.least(moved, F.length(hyp)).alias("j"), taken.alias("out"))

    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("j"), F.lit("").alias("out"))
    # a mark follows every piece but the last
    cuts = F.zip_with(pieces, marks, lambda p, m: F.struct(p.alias("piece"), F.coalesce(m, F.lit("")).alias("mark")))
    folded = F.aggregate(cuts, start, step, lambda s: s.out)
    return F.struct(left.alias("ref"), folded.alias("hyp"), ignored_count(ref, patterns).alias("ignored"))
