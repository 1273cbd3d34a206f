"""Scoring of text pairs: the fourteen metrics, as a struct column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import editdist as E
from ..functions.masking import mask
from ..functions.text import normalize_single_line, tokenize

METRICS = (
    "char_distance", "char_similarity", "char_accuracy", "word_distance", "word_similarity", "word_accuracy", "word_error_rate",
    "ref_words", "hyp_words", "correct_words", "substitutions", "deletions", "insertions", "ignored_chars",
)


def dealt(df: DataFrame, ref: str = "ref", hyp: str = "hyp", parts: int = 200) -> DataFrame:
    """The rows in at most ``parts`` partitions of about the same number of table cells.

    No task can cost less than the longest pair, so there are only as many partitions as have that much each. A pair of half a
    partition's cost or more gets one of its own; the others are dealt around. The driver learns the sum and the largest cost, and
    how many long pairs each input partition has; there are at most twice as many as partitions. Two passes over the texts.
    """
    size = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0)).cast("double") + 1
    rows = df.withColumn("__cells", size(ref) * size(hyp))
    total, most = rows.agg(F.sum("__cells"), F.max("__cells")).first()
    if not total:
        return df
    parts = max(1, min(parts, math.ceil(total / most)))
    alone = F.col("__cells") * 2 * parts >= total
    # numbers of long pairs: those of the partitions before, and the place in the own one
    long = rows.where(alone).withColumn("__m", F.monotonically_increasing_id())
    long = long.withColumns({"__part": F.shiftright("__m", 33), "__at": F.col("__m").bitwiseAND((1 << 33) - 1)})
    before, offsets = 0, []
    for part, n in sorted((r[0], r[1]) for r in long.groupBy("__part").count().collect()):
        offsets.append((part, before))
        before += n
    rest = rows.where(~alone).select(*df.columns)
    left = max(1, parts - before)
    if not before:
        return rest.repartition(left)
    starts = df.sparkSession.createDataFrame(offsets, "__part bigint, __offset bigint")
    long = long.join(F.broadcast(starts), "__part").withColumn("__to", (F.col("__offset") + F.col("__at")).cast("int"))
    return long.repartitionById(before, "__to").select(*df.columns).union(rest.repartition(left))


def score(df: DataFrame, ref: str = "ref", hyp: str = "hyp", ignore: tuple[str, ...] = (), single_line: bool = False, into: str = "m", native: bool = False, spread: int = 0) -> DataFrame:
    """``df`` with a struct of metrics for each pair; null texts give a null struct's counts.

    Order: single-line form of both, then marks masked, then characters and words of what is left. Both distances are taken
    in one passage through Arrow, 64 cells of a table for each step; ``native`` keeps them in SQL expressions, which is
    slower beyond a few words. With ``spread`` the pairs are first dealt to at most so many partitions of like cost, see
    :func:`dealt`, for inputs with pairs that are much longer than others.
    """
    if spread:
        df = dealt(df, ref, hyp, spread)
    texts = [normalize_single_line(F.col(c)) if single_line else F.col(c) for c in (ref, hyp)]
    kept = df.columns
    step = df.withColumn("__p", mask(*texts, list(ignore)))
    step = step.withColumns({"__r": F.col("__p.ref"), "__h": F.col("__p.hyp")})
    a, b, w = tokenize(F.col("__r")), tokenize(F.col("__h")), F.col("__w")
    if native:
        step = step.withColumns({"__a": a, "__b": b})
        step = step.withColumns({"__d": E.char_distance(F.col("__r"), F.col("__h")), "__w": E.align_native(F.col("__a"), F.col("__b"))})
        step = step.withColumns({"__n": F.size("__a"), "__m": F.size("__b")})
    else:
        # words go to Python within their texts alone; those of a pair with a null text are counted here
        step = step.withColumn("__w", E.compare_texts("__r", "__h")).withColumn("__d", F.col("__w.chars"))
        both = w.correct + w.substitutions
        step = step.withColumns({"__n": F.coalesce(both + w.deletions, F.size(a)), "__m": F.coalesce(both + w.insertions, F.size(b))})
    return step.select(*[F.col(f"`{c}`") for c in kept], _metrics().alias(into))


def _metrics() -> Column:
    d, w = F.col("__d"), F.col("__w")
    ref_chars, hyp_chars = F.length("__p.ref"), F.length("__p.hyp")
    n, m = F.col("__n"), F.col("__m")
    wer = E.word_error_rate(w.dist, n)
    values = (
        d, E.similarity(d, ref_chars, hyp_chars), E.char_accuracy(d, ref_chars),
        w.dist, E.similarity(w.dist, n, m), 1 - wer, wer,
        n, m, w.correct, w.substitutions, w.deletions, w.insertions, F.col("__p.ignored"),
    )
    return F.struct(*[v.alias(name) for name, v in zip(METRICS, values, strict=True)])


def score_distinct(df: DataFrame, ref: str = "ref", hyp: str = "hyp", **options) -> DataFrame:
    """Like :func:`score`, but equal pairs are scored once: for inputs with many repeats."""
    pairs = score(df.select(ref, hyp).distinct(), ref, hyp, **options)
    pairs = pairs.withColumnsRenamed({ref: "__r", hyp: "__h"})
    return df.join(pairs, F.col(ref).eqNullSafe(F.col("__r")) & F.col(hyp).eqNullSafe(F.col("__h"))).drop("__r", "__h")
