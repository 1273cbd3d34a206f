"""SimHash near-duplicates, joined by pivot distance tables.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's shingles. Different fingerprints link
if they differ in at most ``BITS`` = 2 bits. Equal ones are one class before any pair is looked at.

Candidates share two of four 16-bit blocks (two differing bits leave at least two blocks alone). In such a bucket every
fingerprint has its Hamming distances to ``PIVOTS`` reference fingerprints; by the triangle inequality a pair whose
distances differ by more than 2 in any coordinate can't link. Rows are in order of the first coordinate, so a pair
is only formed within a difference of 2 there; survivors of all coordinates are verified by their XOR, and only
links that join two parts of a bucket are emitted, never all pairs.

Buckets over ``BUCKET`` fingerprints are split the exact way: each fingerprint is sent to the 65 places within one bit
of it, two link if and only if they meet in a place (at most 65 fingerprints can), and each meets its place's smallest.

Null text is empty text. Texts without words have fingerprint zero and link like any other. A null doc_id takes part
but can't name a component unless nobody else is in it. Repeated rows come out repeated; no rows give no rows. Long texts are
hashed whole, some thousand shingles at a time. Results have the id and the named columns alone, so other columns don't matter;
:func:`one_of_each` gives rows as they came.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bloom import Sieve
from .common import cut, map_batches, record_batch, text_bytes
from .graph import components

BITS = 2
PIVOTS = 16
BUCKET = 4096
_BLOCKS = [0xFFFF << (16 * k) for k in range(4)]
_MASKS = [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(_BLOCKS, 2))]
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k) for k in range(n)], np.uint64)


def majority(h: np.ndarray) -> bytes:
    """What over half of the hashes have in each bit: eight bytes, most significant first."""
    h, ones = h.astype(">u8"), np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprint(data: bytes, words: int = 3) -> bytes:
    """Eight bytes, most significant first."""
    w = data.lower().split()
    if not w:
        return bytes(8)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    return majority(np.fromiter(map(_hash, shingles), np.uint64, n))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): ``fp`` is the fingerprint as a signed 64-bit number."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = b"".join(fingerprint(data, words) for data in text_bytes(batch, text_col))
        return record_batch(**{id_col: batch.column(0), "fp": pa.array(np.frombuffer(prints, ">i8").astype(np.int64))})

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, fp bigint")


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def bucket_links(bucket: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the parts of each bucket; equal ``bucket`` numbers stand together."""
    refs = pivots()
    first = np.bitwise_count(fp ^ refs[0]).astype(np.int16)
    order = np.lexsort((first, bucket))
    bucket, fp, first = bucket[order], fp[order], first[order]
    tables = np.stack([np.bitwise_count(fp ^ p) for p in refs[1:]]).astype(np.int16)
    parent = np.arange(len(fp))
    out_a, out_b = [], []
    left, offset = np.arange(len(fp)), 0
    while True:
        offset += 1
        left = left[left + offset < len(fp)]
        right = left + offset
        near = (bucket[left] == bucket[right]) & (first[right] - first[left] <= bits)
        left = left[near]
        if not len(left):
            break
        a, b = left, left + offset
        for coordinate in tables:
            ok = np.abs(coordinate[a] - coordinate[b]) <= bits
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        a, b = a[ok], b[ok]
        parent = _root(parent)
        fresh = parent[a] != parent[b]
        for i, j in zip(a[fresh].tolist(), b[fresh].tolist(), strict=True):
            ri, rj = i, j
            while parent[ri] != ri:
                ri = parent[ri]
            while parent[rj] != rj:
                rj = parent[rj]
            if ri != rj:
                parent[max(ri, rj)] = min(ri, rj)
                out_a.append(i)
                out_b.append(j)
    return fp[out_a], fp[out_b]


def links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of different fingerprints within two bits, enough to connect every component."""
    keys = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in _MASKS])).alias("block", "part"))
    sizes = keys.groupBy("block", "part").agg(F.count("*").alias("n")).where("n > 1")
    keys = keys.join(sizes, ["block", "part"])

    def pairs(batches):
        held: list[np.ndarray] = []

        def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
            block, part, fp = (np.concatenate([r[k] for r in rows]) for k in range(3))
            change = (block[1:] != block[:-1]) | (part[1:] != part[:-1])
            a, b = bucket_links(np.concatenate([[0], np.cumsum(change)]), fp.view(np.uint64))
            return record_batch(a=pa.array(a.view(np.int64)), b=pa.array(b.view(np.int64)))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy().astype(np.int64) for k in range(3)]
            # all but the last bucket, which may go on in the next batch
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            split = int(last[-1]) + 1 if len(last) else 0
            if split:
                yield linked([*held, tuple(r[:split] for r in rows)])
                held = []
            elif held and (held[-1][0][-1] != rows[0][0] or held[-1][1][-1] != rows[1][0]):
                yield linked(held)
                held = []
            held.append(tuple(r[split:] for r in rows))
        if held:
            yield linked(held)

    small = keys.where(F.col("n") <= bucket).select("block", "part", "fp").repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(pairs, "a bigint, b bigint")
    places = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint")) for k in range(64)])
    large = keys.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(places).alias("place"))
    met = large.groupBy("place").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    met = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()
    return small.union(met)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint, component_id, component_size): one row for each row of ``df``."""
    prints = cut(fingerprints(df, id_col, text_col, words))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    labels = components(links(classes), "a", "b").select(F.col("node").alias("fp"), "label")
    classes = cut(classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    of_print = classes.select("fp", "label").join(named, "label").drop("label")
    return prints.join(of_print, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


# --- similar texts: buckets from linked fingerprints and from the shingles themselves, pairs verified by the sets --------

SIMILAR = 0.8
BANDS, ROWS = 12, 3
#: Longs of a parity fingerprint.
LONGS = 8
_F = [f"f{k}" for k in range(LONGS)]


def _permuted(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.array([xxhash.xxh64_intdigest(b"row %d" % k) for k in range(2 * n)], np.uint64)
    return seeds[:n] | np.uint64(1), seeds[n:]


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """The different shingle hashes, in order."""
    w = data.lower().split()
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(_hash, shingles), np.uint64, max(1, len(w) - words + 1)))


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band; keys of different bands are unlike."""
    a, b = _permuted(BANDS * ROWS)
    least = np.array([((h * x + y) >> np.uint64(16)).min() for x, y in zip(a, b, strict=True)], np.uint64).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)]


def parity(h: np.ndarray) -> np.ndarray:
    """Bit k is the parity of the number of hashes that fall on it: two sets differ in at least as many elements as these in bits."""
    fallen = np.bincount((h >> np.uint64(64 - (64 * LONGS).bit_length() + 1)).astype(np.int64), minlength=64 * LONGS)
    return np.packbits((fallen & 1).astype(np.uint8)).view(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    shared = len(np.intersect1d(x, y, True))
    return shared / (len(x) + len(y) - shared)


def _can_be(similarity: float, n: str, n1: str, other: str):
    """Whether sets of n and n1 elements can have that similarity, by their sizes and their parity fingerprints."""
    a, b = F.col(n), F.col(n1)
    differ = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{other}{f}"))) for f in _F), F.lit(0))
    return (F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9) & (differ <= (1 - similarity) / (1 + similarity) * (a + b) + 1e-9)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def prefix_pairs(shingles: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different label: all pairs whose sets can have that similarity, by prefix filter.

    ``shingles``: class, s; ``facts``: class, label, n and the parity fingerprint. Shingles are in order of their number of texts,
    rarest first. Sets x and y of that similarity share least = s / (1 + s) * (x + y) shingles, so among the first
    x - least + 1 of the one and y - least + 1 of the other is a common one. The smaller set's prefix is the short one:
    what a family shares stands behind it and meets nothing. Pairs are formed only if places and fingerprints allow it.
    """
    often = shingles.groupBy("s").agg(F.count("*").alias("texts")).where("texts > 1")
    met = shingles.join(often, "s").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("texts", "s"))).alias("o")).join(facts, "class")
    near = lambda share: (F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).cast("int")
    # shingles of one text alone come first and meet nothing
    met = met.withColumns({"alone": F.col("n") - F.size("o"), "long": near(similarity), "short": near(2 * similarity / (1 + similarity))}).where("long > alone")
    met = met.select("class", "label", "n", *_F, "short", "alone", F.posexplode(F.slice("o", 1, F.col("long") - F.col("alone"))).alias("at", "o"))
    met = cut(met.select("class", "label", "n", *_F, "short", (F.col("alone") + F.col("at")).alias("i"), "o.s"))
    y = _prefixed(met.where("i < short").drop("short"), "y_")
    least = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("y_n")) - 1e-9)
    larger = (F.col("n") > F.col("y_n")) | (F.col("n") == F.col("y_n")) & (F.col("class") > F.col("y_class"))
    fits = (F.col("s") == F.col("y_s")) & (F.col("label") != F.col("y_label")) & larger & (F.col("n") - F.col("i") >= least) & (F.col("y_n") - F.col("y_i") >= least)
    found = met.join(y, fits & _can_be(similarity, "n", "y_n", "y_"))
    return found.select(F.least("class", "y_class").alias("a"), F.greatest("class", "y_class").alias("b")).distinct()


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with k and t in front: t is the text's hash, null text being empty text, k the hash of id and t. Rows are known by both."""
    t = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.xxhash64(F.col(id_col).isNull(), id_col, t).alias("k"), t.alias("t"), "*")


def _open_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """(class, label): texts of a bucket that are neither its first nor its last one and not all in one group."""
    rest = members.where("class <> lo and class <> hi").select("key", "class").join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    rest = cut(rest)
    mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return rest.join(mixed, "key", "left_semi").select("class", "label").distinct()


def print_buckets(rows: DataFrame) -> DataFrame:
    """(class, key) of rows with ``class`` and ``fp``: the component of the class's fingerprint, linked as in :func:`links`."""
    classes = cut(rows.select("class", "fp").distinct())
    label = components(links(classes.select("fp").distinct()), "a", "b").select(F.col("node").alias("fp"), "label")
    return classes.join(label, "fp", "left").select("class", F.coalesce("label", "fp").alias("key"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """(id, k, t, class, check, label) for each row: ``label`` is the number of its group of texts linked by a shingle similarity of ``similarity`` or more.

    Buckets are of two kinds. The one is SimHash by pivot distance tables: the components of the fingerprints of the shingle sets,
    linked within two bits (:func:`links`). That finds almost equal texts; those of similarity 0.8 differ in ten bits of
    64, where blocks and pivot distances discard nothing. So the other is bands of minimal shingle hashes: texts of similarity 0.8 meet in
    at least one of twelve with a chance of 0.9998. In a bucket every text is paired with the first and the last class of it,
    so rows grow with the texts whatever the bucket's size, and large groups are connected through these. Where that leaves a
    bucket in several groups, its other texts are compared across groups by an exact prefix filter over their shingle
    sets. Pairs are discarded by sizes and by parity fingerprints, which never differ in more bits than the sets in
    shingles, so no similar pair is lost; what is left is verified by the sets themselves.

    Texts with equal shingle sets are one class. Only the texts of classes that meet another one are fetched again,
    once, through a filter of bounded size. ``k``, ``t``: see :func:`_keyed`. ``check``: 64 more bits of the shingle set than ``class``.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = _keyed(df.select(id_col, text_col), id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, names, checks, prints, majorities, sizes = [], [], [], [], [], []
        for data in text_bytes(batch, text_col):  # one text's shingles at a time
            h = shingle_set(data, words)
            keys += band_keys(h)
            names.append(xxhash.xxh64_intdigest(h.tobytes()))
            checks.append(xxhash.xxh64_intdigest(h.tobytes(), 1))
            prints.append(parity(h))
            majorities.append(majority(h))
            sizes.append(len(h))
        keys, names, checks = (np.array(v, np.uint64).view(np.int64) for v in (keys, names, checks))
        prints = np.stack(prints)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
        return record_batch(**{
            id_col: batch.column(2), "k": batch.column(0), "t": batch.column(1), "class": pa.array(names), "check": pa.array(checks), "n": pa.array(sizes, pa.int32()),
            "fp": pa.array(np.frombuffer(b"".join(majorities), ">i8").astype(np.int64)),
            **{f: pa.array(np.ascontiguousarray(prints[:, j])) for j, f in enumerate(_F)}, "bands": pa.ListArray.from_arrays(offsets, pa.array(keys)),
        })

    rows = cut(map_batches(texts, run, f"`{id_col}` {kind}, k bigint, t bigint, class bigint, check bigint, n int, fp bigint, {', '.join(f'{f} bigint' for f in _F)}, bands array<bigint>"))
    keys = rows.select("class", F.explode("bands").alias("key")).union(print_buckets(rows))
    buckets = keys.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    members = cut(keys.join(buckets, "key").distinct())
    one = rows.join(members.select("class").distinct(), "class").groupBy("class").agg(F.min(F.struct("k", "t")).alias("row"), *[F.min(c).alias(c) for c in ("n", *_F)])
    facts = cut(one.select("class", "row.*", "n", *_F))
    wanted = facts.select("k", "t", "class")
    bodies = Sieve(wanted).rows(texts.select("k", "t", text_col), "k", "t").dropDuplicates(["k", "t"]).join(wanted, ["k", "t"])

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(data, words).tobytes() for data in text_bytes(batch, text_col)]
        return record_batch(**{"class": batch.column("class"), "set": pa.array(made, pa.binary())})

    sets = cut(map_batches(bodies.select("class", text_col), sets_of, "class bigint, set binary"))

    def verified(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = [jaccard(x.as_py(), y.as_py()) >= similarity for x, y in zip(batch.column("a_set"), batch.column("b_set"), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        held = pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
        return cut(map_batches(held, verified, "a bigint, b bigint"))

    def exploded(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("set")]
        which = pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made]))
        return record_batch(**{"class": batch.column("class").take(which), "s": pa.array(np.concatenate(made))})

    own = facts.select("class", "n", *_F)
    pairs = members.select("class", F.explode(F.array("lo", "hi")).alias("other")).where("class <> other")
    pairs = pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
    pairs = pairs.join(_prefixed(own, "a_"), F.col("a") == F.col("a_class")).join(_prefixed(own, "b_"), F.col("b") == F.col("b_class"))
    differ = pairs.withColumnsRenamed({f"a_{f}": f for f in _F}).where(_can_be(similarity, "a_n", "b_n", "b_"))
    links = linked(cut(differ.select("a", "b")))
    label = components(links, "a", "b").select(F.col("node").alias("class"), "label")
    left = cut(_open_buckets(members, label))
    if not left.isEmpty():
        shingles = map_batches(sets.join(left.select("class"), "class", "left_semi"), exploded, "class bigint, s bigint")
        links = links.union(linked(cut(prefix_pairs(shingles, own.join(left, "class"), similarity))))
        label = components(links, "a", "b").select(F.col("node").alias("class"), "label")
    return rows.select(id_col, "k", "t", "class", "check").join(label, "class", "left").select(id_col, "k", "t", "class", "check", F.coalesce("label", "class").alias("label"))


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """(id, component_id) for each row: groups of texts linked by a shingle similarity of ``similarity`` or more."""
    rows = cut(similar_groups(df, id_col, text_col, words, similarity))
    least = rows.groupBy("label").agg(F.min(id_col).alias("component_id"))
    return rows.join(least, "label").select(id_col, "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """The rows of ``df`` that stay: of each group of similar texts the one with the smallest id, nulls last.

    Rows are known by id and text, so unlike texts under one id, or under none, all stay; of rows with equal id and text one
    stays. Where two different shingle sets have one class's number, the whole group stays. Rows of groups of one go straight through: only rows that a filter of bounded size takes for members
    of a larger group meet the verdicts in a join.
    """
    rows = cut(similar_groups(df, id_col, text_col, words, similarity))
    own = F.struct(F.col(id_col).isNull().alias("null"), id_col, "k", "t")
    classes = rows.groupBy("label", "class").agg(F.min(own).alias("own"), F.count("*").alias("n"), (F.min("check") != F.max("check")).alias("odd"))
    groups = classes.groupBy("label").agg(F.min("own").alias("own"), F.sum("n").alias("n"), F.bool_or("odd").alias("odd")).where("n > 1")
    stays = F.col("odd") | (F.col("k") == F.col("own.k")) & (F.col("t") == F.col("own.t"))
    judged = cut(rows.join(groups, "label").select("k", "t", stays.alias("stays")).distinct())
    keyed, sieve = _keyed(df, id_col, text_col), Sieve(judged)
    names = [f"`{c}`" for c in df.columns]
    # clashing names: the two keys stand in front
    plain = keyed.toDF("__k", "__t", *df.columns)
    alone = sieve.rows(plain, "__k", "__t", False).select(*names)
    met = sieve.rows(plain, "__k", "__t").join(judged.toDF("__k", "__t", "__stays"), ["__k", "__t"], "left").where("__stays is null or __stays")
    whole = F.struct(*[F.col(n) for n in names]).alias("row")
    once = met.where("__stays").groupBy("__k", "__t").agg(F.first(whole).alias("row")).select("row.*")
    met = met.where("__stays is null").select(*names).union(once)
    return alone.union(met)
