"""The trie of conversation prefixes by partition refinement.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. All conversations start in one class.
A round takes the next turn of every active class's conversations and splits the class by it. A class of one sequence
is retired: the rest of it is a chain of nodes with one child each, emitted at once without further rounds. When no class is active, the
rounds are folded back, deepest first: a class's leaves and saved tokens are its children's, summed, and its own.

Conversations with equal turns throughout are one sequence from the start, with a weight, so copies never keep a class active, and
rounds go as deep as two different sequences agree. Where no class splits in a round, the next one takes twice as many turns at a
time, as long as nothing splits in them; so a long stretch that all share costs rounds by its logarithm.

Turns are ordered by number, null first; equal numbers go by a digest of role and text. Null role and text are empty. Rows without a
conversation's number are left out. Repeated rows are turns of their own. Texts are compared by 128 bits of SHA-256 and never
shuffled; conversations by 128 bits of their turns' digests and places. No rows give no nodes. Columns other than the four named don't
matter. Names given by ``copied`` decide how conversations are put together before the trie is made; without it they are as they stand.

One conversation may hold any share of the rows: turns are numbered by ranges of (conversation, order), each range in its own task,
and a range's first number is what the ranges before it hold. Copies' numbers are sorted by ranges too and joined to text there; one
task hashes a group's text as it streams by, which SHA-256 can't do in parts. Each round is cut in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, record_batch, shared_dir

#: Numbers that are joined to one piece of text before they are hashed.
PIECE = 200
EMPTY = hashlib.sha256().hexdigest()

def ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, digest, size, upto): turns from 1 on, code points of each text and of all up to it."""
    said = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text)]
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said), 256)), 1, 16)
    rows = df.select(F.col(f"`{conv}`").cast("bigint").alias("c"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.length(said[1]).cast("bigint").alias("size"))
    ranges = rows.where("c is not null").repartitionByRange("c", F.asc_nulls_first("turn"), "digest")
    ranges = cut(ranges.withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part", "c").orderBy(F.asc_nulls_first("turn"), "digest").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranges.withColumns({"pos": F.count("*").over(order), "upto": F.sum("size").over(order)})
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranges.groupBy("c", "part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    held = held.select("c", "part", F.sum("n").over(before).alias("n"), F.sum("s").over(before).alias("s")).where("n is not null")
    # few conversations lie in more than one range
    placed = inside.join(held, ["c", "part"], "left").fillna(0, ["n", "s"])
    return placed.select("c", (F.col("pos") + F.col("n")).alias("pos"), "digest", "size", (F.col("upto") + F.col("s")).alias("upto"))


def spliced(turns: DataFrame, base: Column, heads: Column, longest: int) -> DataFrame:
    """Turns of conversations whose first ``heads`` turns (at most ``longest``) are those of conversation ``base``.

    ``base`` and ``heads`` are columns made of ``c``. A base that isn't there has no turns. Conversations that have no turns
    left stay as a row without digest at place 0.
    """
    turns = cut(turns)
    own = turns.groupBy("c").agg(F.max(F.when(F.col("pos") <= heads, F.col("upto"))).alias("skipped"))
    own = own.select("c", base.alias("base"), heads.cast("bigint").alias("h"), F.coalesce("skipped", F.lit(0)).alias("skipped"))
    first = turns.where(F.col("pos") <= longest).groupBy(F.col("c").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size", "upto"))).alias("head"))
    first = first.join(own.select("base").distinct(), "base", "left_semi")
    shift = own.join(first, "base", "left").withColumn("head", F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h").cast("int"))))
    shift = shift.withColumn("head", F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,size:bigint,upto:bigint>>")))
    shift = cut(shift.withColumns({"n": F.size("head").cast("bigint"), "upto": F.coalesce(F.try_element_at("head", F.lit(-1)).getField("upto"), F.lit(0))}))
    tail = turns.alias("t").join(shift.select("c", "h", "n", "skipped", F.col("upto").alias("taken")), "c").where(F.col("pos") > F.col("h"))
    tail = tail.select("c", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "digest", "size", (F.col("upto") - F.col("skipped") + F.col("taken")).alias("upto"))
    none = shift.select("c", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("upto"))
    return shift.select("c", F.inline("head")).union(tail).union(none)


def _hashes(groups: DataFrame) -> DataFrame:
    """(s, ends): SHA-256 of each group's numbers ``c``, ascending, joined by commas."""

    def pieces(batches):
        at, numbers = None, []

        def taken():
            return record_batch(s=pa.array([at], pa.int64()), first=pa.array([numbers[0]], pa.int64()), piece=pa.array([",".join(map(str, numbers))], pa.string()))

        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if numbers and (s != at or len(numbers) == PIECE):
                    yield taken()
                    numbers = []
                at = s
                numbers.append(c)
        if numbers:
            yield taken()

    def hashed(batches):
        at, running = None, None
        for batch in batches:
            done_s, done = [], []
            for s, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s == at:
                    running.update(b",")
                else:
                    if running:
                        done_s.append(at)
                        done.append(running.hexdigest())
                    at, running = s, hashlib.sha256()
                running.update(piece.encode())
            yield record_batch(s=pa.array(done_s, pa.int64()), ends=pa.array(done, pa.string()))
        if running:
            yield record_batch(s=pa.array([at], pa.int64()), ends=pa.array([running.hexdigest()], pa.string()))

    sorted_ids = groups.select("s", "c").repartitionByRange("s", "c").sortWithinPartitions("s", "c")
    text = sorted_ids.mapInArrow(pieces, "s bigint, first bigint, piece string")
    text = text.repartition("s").sortWithinPartitions("s", "first").select("s", "piece")
    return text.mapInArrow(hashed, "s bigint, ends string")


def _sequences(turns: DataFrame) -> DataFrame:
    """Each distinct sequence, named after its first conversation: (s, n, w, total, ends): its turns, conversations, code points, hash."""
    word = lambda *of: F.bit_xor(F.when(F.col("pos") > 0, F.xxhash64(*of)).otherwise(0))
    whole = turns.groupBy("c").agg(F.max("pos").alias("n"), word("pos", "digest").alias("x"), word("digest", F.lit("|"), "pos").alias("y"), F.max("upto").alias("total"))
    whole = cut(whole)
    same = whole.groupBy("n", "x", "y").agg(F.min("c").alias("s"), F.count("*").alias("w"), F.max("total").alias("total"))
    same = cut(same)
    many = whole.join(same.where("w > 1"), ["n", "x", "y"])
    alone = same.where("w = 1").select("s", F.sha2(F.col("s").cast("string"), 256).alias("ends"))
    ends = alone.union(_hashes(many))
    return same.select("s", "n", "w", "total").join(ends, "s")


_UP = "k bigint, children bigint, leaves bigint, saved bigint"


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copied: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    ``copied``: from turns as :func:`ordered` gives them to turns of the conversations put together, as :func:`spliced` does.
    """
    spark = df.sparkSession
    turns = ordered(df, conv, turn, role, text)
    turns = cut(copied(turns) if copied else turns)
    sequences = cut(_sequences(turns))
    folder = f"{shared_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    # sorted by place: a round reads the row groups of its own turns
    kept = turns.where("pos > 0").withColumnRenamed("c", "s").join(sequences.select("s"), "s", "left_semi")
    kept.repartitionByRange("pos", "s").sortWithinPartitions("pos", "s").write.parquet(folder)
    try:
        nodes = _refined(spark.read.schema(kept.schema).parquet(folder), sequences)
    finally:
        gone = spark._jvm.org.apache.hadoop.fs.Path(folder)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return nodes


def _refined(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    long = lambda v: F.lit(v).cast("bigint")
    root = sequences.agg(F.min("s").alias("k"), F.sum("w").alias("w"), F.count("*").alias("n_seqs")).where("n_seqs > 0")
    root = cut(root)
    if root.isEmpty():
        return root.select(*[F.lit(None).cast(t).alias(c) for c, t in _COLUMNS])
    k = root.first()["k"]
    #: per round: its classes of more than one sequence, one row for each node, ``bottom`` its last depth
    rounds = [(root.select("k", long(0).alias("depth"), F.lit(None).cast("bigint").alias("parent"), "w", long(0).alias("rest")), 0)]
    ended = [sequences.where("n = 0").select(long(k).alias("k"), long(0).alias("depth"), "ends")]
    retired: list[DataFrame] = []
    active = sequences.where("n > 0").select("s", long(k).alias("k"), "n", "w")
    depth, stride = 0, 1
    while True:
        ahead = turns.where(F.col("pos").between(depth + 1, depth + stride))
        met = ahead.join(active, "s")
        if stride == 1:
            met = met.select("s", "k", "n", "w", "digest", "size", "upto")
        else:
            word = lambda *of: F.bit_xor(F.xxhash64(*of))
            met = met.groupBy("s", "k", "n", "w").agg(F.struct(word("pos", "digest"), word("digest", F.lit("|"), "pos")).alias("digest"), F.sum("size").alias("size"), F.max("upto").alias("upto"))
        split = met.groupBy("k", "digest").agg(F.min("s").alias("k2"), F.count("*").alias("n_seqs"), F.sum("w").alias("class_w"))
        now = cut(met.join(split, ["k", "digest"]).select("s", "k", "n", "w", "size", "upto", "k2", "n_seqs", "class_w"))
        bottom = depth + stride
        seen = now.agg(F.count("*").alias("rows"), F.count_distinct("k").alias("before"), F.count_distinct("k2").alias("after"), F.max(F.col("n_seqs") == 1).alias("single"), F.min("n").alias("shortest"), F.max(F.when(F.col("n_seqs") > 1, F.col("n"))).alias("longest")).first()
        if not seen["rows"]:
            break
        whole = seen["before"] == seen["after"] and not seen["single"]
        if stride > 1 and not (whole and seen["shortest"] >= bottom):
            stride = max(1, stride // 4)  # something splits or ends in between
            continue
        classes = now.where("n_seqs > 1").groupBy("k2").agg(F.first("k").alias("parent"), F.first("class_w").alias("w"), F.first("size").alias("size"), F.first("upto").alias("upto"))
        if stride == 1:
            level = classes.select(F.col("k2").alias("k"), long(bottom).alias("depth"), "parent", "w", F.col("size").alias("rest"))
        else:
            last = classes.select(F.col("k2").alias("s"), "w", F.col("upto").alias("last"))
            # all have the first one's turns
            level = ahead.join(last, "s").select(F.col("s").alias("k"), F.col("pos").alias("depth"), F.col("s").alias("parent"), "w", (F.col("last") - F.col("upto") + F.col("size")).alias("rest"))
        rounds.append((cut(level), bottom))
        retired.append(now.where("n_seqs = 1").select("s", long(bottom).alias("top"), F.col("k").alias("above")))
        ended.append(now.where((F.col("n_seqs") > 1) & (F.col("n") == bottom)).select(F.col("s"), F.col("k2").alias("k")).join(sequences, "s").select("k", long(bottom).alias("depth"), "ends"))
        if seen["longest"] is None or seen["longest"] <= bottom:
            break
        active = now.where((F.col("n_seqs") > 1) & (F.col("n") > bottom)).select("s", F.col("k2").alias("k"), "n", "w")
        depth, stride = bottom, stride * 2 if whole else 1

    chains = _chains(turns, sequences, retired)
    tops = chains.where("depth = top").select(F.col("parent_conv_id").alias("k"), F.col("depth").alias("at"), "n_leaves", "saved_tokens") if chains is not None else None
    folds, below = [], None
    for level, bottom in reversed(rounds):
        up = below
        if tops is not None:
            mine = tops.where(F.col("at") == bottom + 1).drop("at")
            up = mine if up is None else up.union(mine)
        if up is None:
            folded = level.withColumns({"children": long(0), "leaves": long(1), "saved": long(0)})
        else:
            up = up.groupBy("k").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            folded = level.join(up, "k", "left").fillna({"children": 0, "leaves": 1, "saved": 0})
        saved = F.col("saved") + (F.col("w") - 1) * F.col("rest")
        children = F.when(F.col("depth") < bottom, long(1)).otherwise(F.col("children"))
        folded = folded.select(F.col("k").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("w").alias("n_convs"), children.alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"))
        folded = cut(folded)
        highest = folded.groupBy(F.col("conv_id").alias("k")).agg(F.min_by(F.struct("parent_conv_id", "n_leaves", "saved_tokens"), "depth").alias("t"))
        below = highest.select(F.col("t.parent_conv_id").alias("k"), "t.n_leaves", "t.saved_tokens")
        folds.append(folded)
    inner = reduce(DataFrame.union, folds)
    ends = reduce(DataFrame.union, ended).select(F.col("k").alias("conv_id"), "depth", "ends")
    inner = inner.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY)))
    names = [c for c, _ in _COLUMNS]
    out = inner.select(*names)
    if chains is not None:
        out = out.union(chains.select(*names))
    return cut(out)


_COLUMNS = (("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string"))


def _chains(turns: DataFrame, sequences: DataFrame, retired: list[DataFrame]) -> DataFrame | None:
    """The nodes of retired sequences, each with its depth and the depth ``top`` at which it was retired."""
    if not retired:
        return None
    gone = reduce(DataFrame.union, retired).join(sequences, "s")
    rows = turns.join(gone, "s").where(F.col("pos") >= F.col("top"))
    leaf = F.col("pos") == F.col("n")
    return cut(rows.select(
        F.col("s").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("above")).otherwise(F.col("s")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), F.when(leaf, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("upto") + F.col("size"))).alias("saved_tokens"), F.when(leaf, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"), "top",
    ))
