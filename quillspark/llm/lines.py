"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A text's lines with at least one word are hashed. The gram of a line is the shortest run of lines from it on that has
``GRAM`` words or more. Winnowing selects, in every window of lines that begin within the next ``GRAM`` words, the gram
with the smallest hash; a window's grams lie inside any run of ``2 * GRAM`` words that holds the window's first line, so such a
run, wherever it stands, has the same fingerprint.

What is deleted are runs of lines: the shortest ones of ``LEAST`` words or more that begin with a line, and those that end
with one; every line of a longer run is in one of them that lies inside it. A run can stand elsewhere only if the fingerprint
chosen by its first line does. Runs whose fingerprint is repeated are compared by 128 bits of all their lines, and each but the
earliest of equal ones goes, so nothing depends on which other place has the same gram.

Order is by (doc_id, hash of the text, line number), nulls first. Rows with equal doc_id and text are one text: they
are treated alike, and repeats within it are deleted once. Null text stays null, blank lines are never deleted, texts without
repeats come out as they went in, and a text whose every line is deleted becomes its blank lines. No rows give no rows. A long
text is one row for each of its lines. Columns are kept, but for one named ``n_removed``, which is replaced.

No row pairs of a group are formed: a line has at most two runs, a run meets one earliest place. Counts and minima over
frequent grams and runs are combined before the shuffle, and the joins that a frequent one skews are plain
equi-joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

GRAM = 25
LEAST = 50
_WORDS = r"[^ \t\n\x0B\f\r]+"


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k: the text's key; pos, h, h2, w: line number, hashes, words; b: words before the line; only lines with words."""
    texts = df.where(F.col(text_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t")).alias("k"), text_col)
    lines = texts.select("k", F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    lines = lines.select("k", "pos", F.xxhash64("line", F.length("line")).alias("h"), F.xxhash64(F.lit(2), "line").alias("h2"), F.regexp_count("line", F.lit(_WORDS)).alias("w")).where("w > 0")
    lines = lines.repartition("k").dropDuplicates(["k", "pos"])  # rows with equal id and text; no second shuffle
    before = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("b", F.coalesce(F.sum("w").over(before), F.lit(0)).cast("bigint"))


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """(k, start, stop): first and last line of what to delete, apart from each other; ``k`` is struct(id, hash of the text)."""
    by_text = Window.partitionBy("k")
    by_place = by_text.orderBy("b")
    ahead = by_place.rangeBetween(0, gram - 1)
    window = by_place.rangeBetween(0, gram)
    onward = by_place.rangeBetween(0, least - 1)

    def both(window) -> Column:
        """128 bits of a window's lines: runs are deleted by these alone."""
        held = F.collect_list(F.struct("h", "h2")).over(window)
        return F.struct(F.xxhash64(held).alias("a"), F.xxhash64(F.lit(2), held).alias("b"))

    lines = _numbered(df, id_col, text_col).withColumn("e", F.col("b") + F.col("w"))
    upto = by_text.orderBy("e").rangeBetween(1 - least, 0)
    lines = lines.withColumns({
        "total": F.max("e").over(by_text),
        "g": F.when(F.col("b") + gram <= F.max("e").over(by_text), F.xxhash64(F.collect_list("h").over(ahead))),
        "run": both(onward),
        "stop": F.last("pos").over(onward),
    })
    chosen = F.when(F.col("b") + 2 * gram <= F.col("total"), F.min(F.when(F.col("g").isNotNull(), F.struct("g", "pos"))).over(window))
    lines = lines.withColumn("chosen", chosen)
    # a gram is picked if a window that begins at most ``gram`` words before it chose it
    behind = F.collect_set("chosen.pos").over(by_place.rangeBetween(-gram, 0))
    # no run without ``least`` words; one that ends here and is also the one that begins with its first line isn't named twice
    begins = F.when(F.col("b") + least <= F.col("total"), F.struct("chosen.g", "run", F.col("pos").alias("start"), "stop"))
    first = F.first(F.struct("chosen.g", "pos", "stop")).over(upto)
    ends = F.when((F.col("e") >= least) & (first.getField("stop") != F.col("pos")), F.struct(first.getField("g").alias("g"), both(upto).alias("run"), first.getField("pos").alias("start"), F.col("pos").alias("stop")))
    lines = cut(lines.select("k", F.when(F.array_contains(behind, F.col("pos")), F.col("g")).alias("picked"), begins.alias("begins"), ends.alias("ends")))

    often = lines.where("picked is not null").groupBy(F.col("picked").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g")
    runs = lines.select("k", F.explode(F.array_compact(F.array("begins", "ends"))).alias("r")).select("k", "r.*")
    runs = runs.join(often, "g", "left_semi").select("run", "k", "start", "stop")
    here = F.struct("k", "start")
    earliest = runs.groupBy("run").agg(F.min(here).alias("earliest"), F.count("*").alias("n")).where("n > 1").select("run", "earliest")
    gone = runs.join(earliest, "run").where(here > F.col("earliest")).select("k", "start", "stop")
    # runs that overlap or touch are one
    before = by_text.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-2)) + 1).cast("int")
    gone = gone.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(by_text.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    return gone.groupBy("k", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """``df`` with later repeated runs deleted from its text, and ``n_removed`` lines; a column of that name is replaced."""
    kept = [c for c in df.columns if c.lower() != "n_removed"]
    gone = repeated_runs(df, id_col, text_col, gram, least).groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    gone = gone.select(F.col("k.id").alias("__id"), F.col("k.t").alias("__t"), "gone")
    key = F.col(f"d.{id_col}").eqNullSafe(F.col("g.__id")) & (F.xxhash64(f"d.{text_col}") == F.col("g.__t"))
    joined = df.select(*[F.col(f"`{c}`") for c in kept]).alias("d").join(gone.alias("g"), key, "left")
    lost = F.col("g.gone")
    split = F.split(f"d.{text_col}", "\n")
    left = F.filter(split, lambda line, i: ~(line.rlike(_WORDS) & F.exists(lost, lambda r: i.between(r.start, r.stop))))
    text = F.when(lost.isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(left, "\n")).alias(text_col)
    n_removed = F.when(lost.isNull(), F.lit(0)).otherwise(F.size(split) - F.size(left)).cast("bigint").alias("n_removed")
    return joined.select(*[text if c == text_col else F.col(f"d.`{c}`") for c in kept], n_removed)
