"""Source divergence audit by joint count histograms.

Each source's word frequencies within its language are smoothed and compared with every other source's of that language and
with the language's own. A smoothed share depends on a term's count alone, so for a pair of sources all terms with the same two
counts contribute the same: tallied are the distinct (count, count) combinations, and the difference is evaluated once for
each and taken times its multiplicity. Only terms that both sources have are met in the data. The cells with a zero follow: those
of one count against zero are the count's terms less those met with the other source, and zero against zero is the
vocabulary less what either has.

A term is a run of characters other than ASCII ones that aren't letters, with A-Z lower-cased. A language keeps the terms that are in at
least ``LEAST`` of its documents. Arithmetic is exact: shares are whole numbers of a billionth, divided as decimals.

Null language, source and text are empty ones, and an empty name is a name like others. Each row is a document of its own, repeated
ones too. Every occurring (language, source) is compared, without terms as well; a language that keeps no term has
differences of zero and no terms. Equal values go by the item's UTF-8. No rows give no rows. A long text is counted
whole in its task. Columns other than the three named don't matter.

A task counts what it reads before anything is shuffled and lets its counts go when it holds ``HELD`` of them, so a hot source costs a row for
each term and task. Tallies are made of ``BLOCK`` counts at a time from rows sorted by term: a term has one row for each source, and what is
emitted are combinations, not pairs of rows. Only (language, source) pairs, which the result lists, are joined in full.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, record_batch, text_bytes

LEAST = 30
TOP = 50
SMOOTHING = 5
SCALE = 1_000_000_000
HELD = 400_000
BLOCK = 1 << 16
#: Row pairs of one block that are tallied at a time.
PAIRS = 1 << 20
#: bytes.translate table: letters lower-cased, bytes of other characters kept, all else a space.
_LETTERS = bytes(b if b >= 128 else b | 32 if 65 <= b & ~32 <= 90 else 32 for b in range(256))


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)


def _partial_counts(batches):
    """(lang, source, term, n, docs) of what a task has read, in pieces."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def emptied():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                yield record_batch(
                    lang=_strings([lang] * len(some)), source=_strings([source] * len(some)), term=_strings(some),
                    n=pa.array([n[t] for t in some], pa.int64()), docs=pa.array([docs[t] for t in some], pa.int64()),
                )
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(text_bytes(batch, k) for k in range(3)), strict=True):
            terms = text.translate(_LETTERS).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n)
            if size > HELD:
                yield from emptied()
                size = 0
    yield from emptied()


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, total): occurrences of each kept term in a source that has it, and in its language."""
    read = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = read.mapInArrow(_partial_counts, "lang string, source string, term string, n bigint, docs bigint")
    # one shuffle serves the sums of a source and those of its language
    counted = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term)})
    return counted.where(F.col("docs") >= least).select("lang", "source", "term", "n", "total")


def _tally(batches):
    """(lang, s, o, a, b, m): of rows sorted by lang, term and source, how many terms have count a in s and b in o, s before o."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            table = pa.Table.from_batches(waiting)
            last = [table.column(c)[-1] for c in ("lang", "term")]
            same = pc.and_(pc.equal(table.column("lang"), last[0]), pc.equal(table.column("term"), last[1]))
            whole = rows - pc.sum(same).as_py()
            yield from _tallied(table.slice(0, whole))
            waiting = table.slice(whole).combine_chunks().to_batches()  # the last term may go on
            rows -= whole
    if rows:
        yield from _tallied(pa.Table.from_batches(waiting))


def _tallied(table: pa.Table):
    if not table.num_rows:
        return
    coded = {c: table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source")}
    lang, term, source = (coded[c].indices.to_numpy() for c in ("lang", "term", "source"))
    n = table.column("n").to_numpy()
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])])
    end = np.repeat(np.r_[first[1:], len(term)], np.diff(np.r_[first, len(term)]))
    left, right, size = [], [], 0
    here = np.arange(len(term))

    def emptied():
        i, j = np.concatenate(left), np.concatenate(right)
        pairs = pa.table({"lang": lang[i], "s": source[i], "o": source[j], "a": n[i], "b": n[j]})
        found = pairs.group_by(pairs.column_names).aggregate([([], "count_all")])
        names = {"lang": "lang", "s": "source", "o": "source"}
        columns = {c: pc.take(coded[of].dictionary, found.column(c).combine_chunks()) for c, of in names.items()}
        return record_batch(**columns, a=found.column("a").combine_chunks(), b=found.column("b").combine_chunks(), m=found.column("count_all").combine_chunks())

    ahead = 1
    while len(here := here[here + ahead < end[here]]):
        for at in range(0, len(here), PAIRS):
            some = here[at : at + PAIRS]
            left.append(some)
            right.append(some + ahead)
            size += len(some)
            if size >= PAIRS:
                yield emptied()
                left, right, size = [], [], 0
        ahead += 1
    if size:
        yield emptied()


def joint_histograms(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, s, o, a, b, m): all combinations of each pair of a language's sources, s before o, those with zeros too."""
    cells = cells.select("lang", "term", "source", "n")
    met = cells.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    met = met.mapInArrow(_tally, "lang string, s string, o string, a bigint, b bigint, m bigint")
    met = met.groupBy("lang", "s", "o", "a", "b").agg(F.sum("m").alias("m"))
    zero = F.lit(0).cast("bigint")

    def cell(a, b, m) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), m.alias("m"))

    a, b, m = F.col("a"), F.col("b"), F.col("m")
    # a term met with both counts is none of those with a zero in either place
    signed = [met.select("lang", "s", "o", F.inline(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))))]
    one, other = groups.select("lang", F.col("source").alias("s"), "v"), groups.select("lang", F.col("source").alias("o"))
    pairs = one.join(other, "lang").where("s < o")
    signed.append(pairs.select("lang", "s", "o", zero.alias("a"), zero.alias("b"), F.col("v").alias("m")))
    counts = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    for side, mine in (("s", cell(F.col("n"), zero, m)), ("o", cell(zero, F.col("n"), m))):
        own = pairs.join(counts.withColumnRenamed("source", side), ["lang", side])
        signed.append(own.select("lang", "s", "o", F.inline(F.array(mine, cell(zero, zero, -m)))))
    every = signed[0]
    for more in signed[1:]:
        every = every.unionByName(more)
    return every.groupBy("lang", "s", "o", "a", "b").agg(F.sum("m").alias("m")).where("m > 0")


def _share(count: str, total: str, size: str, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * size)), exactly."""
    return F.expr(f"1 + (CAST({scale} AS DECIMAL(12, 0)) * CAST({count} + {smoothing} AS DECIMAL(20, 0))) DIV CAST({total} + {smoothing} * {size} AS DECIMAL(20, 0))")


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP, smoothing: int = SMOOTHING, scale: int = SCALE) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: for each other source of the language the sum of differences over all kept terms. Part ``term``: the ``top`` terms of a source
    whose share exceeds the language's by most.
    """
    cells = cut(term_counts(df, lang, source, text, least))
    terms = cells.groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = df.select(F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source")).distinct()
    groups = cut(groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["source_n", "lang_n", "v"]))

    joint = joint_histograms(cells, groups)
    for side, count in (("s", "a"), ("o", "b")):
        size = groups.select("lang", F.col("source").alias(side), F.col("source_n").alias("total"), "v")
        joint = joint.join(size, ["lang", side]).withColumn(f"p_{count}", _share(count, "total", "v", smoothing, scale)).drop("total", "v")
    values = joint.groupBy("lang", "s", "o").agg(F.sum(F.abs(F.col("p_a") - F.col("p_b")) * F.col("m")).alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    both = values.select("lang", F.inline(F.array(F.struct(F.col("s").alias("source"), F.col("o").alias("item"), "value"), F.struct(F.col("o").alias("source"), F.col("s").alias("item"), "value"))))
    pairs = pairs.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"])

    found = cells.join(groups, ["lang", "source"])
    value = _share("n", "source_n", "v", smoothing, scale) - _share("total", "lang_n", "v", smoothing, scale)
    found = found.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").union(ranked(found, "term").where(F.col("rank") <= top))
