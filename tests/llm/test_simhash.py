import os
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash as S
from quillspark.llm.graph import components

from .cases import empty, frame, many_partitions


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute_components(prints):
    """prints: list of ints; the set of components as sets of places."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(len(prints)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def test_same_hash_as_spark(spark):
    assert spark.range(1).select(F.lower(F.hex(F.xxhash64(F.lit("a b c"))))).first()[0] == f"{S._hash(b'a b c'):x}"


def test_near_duplicates(spark):
    df = frame(spark, clash=("fp", "component_id"))
    got = S.near_duplicates(df).collect()
    rows = df.select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    want = []
    for group in brute_components(prints):
        ids = [rows[i]["doc_id"] for i in group if rows[i]["doc_id"] is not None]
        want += [(rows[i]["doc_id"], f"{prints[i]:016x}", min(ids, default=None)) for i in group]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)


@pytest.mark.parametrize("bucket", [4096, 6])
def test_links_connect_dense_clusters(spark, bucket):
    rnd = random.Random(7)
    found = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(50):
            x = base
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            found.add(x)
    prints = sorted(found)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), bucket)
    assert links.count() < 65 * len(prints)
    label = {r["node"]: r["label"] for r in components(links, "a", "b").collect()}
    groups = defaultdict(set)
    for i, p in enumerate(signed):
        groups[label.get(p, p)].add(i)
    assert {frozenset(g) for g in groups.values()} == brute_components(prints)


def test_pivots_discard_nothing_near():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    far = np.stack([np.abs(np.bitwise_count(x ^ p).astype(int) - np.bitwise_count(y ^ p)) for p in S.pivots()]).max(0)
    assert far.max() <= 2


def test_empty_table(spark):
    assert S.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(60)}


def test_rounds_have_tasks_for_their_links_not_for_the_shuffle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with many_partitions(spark, "components") as stages:
        assert {r["label"] for r in components(edges, "a", "b").collect()} == {0}
    # the given links are made distinct by the shuffle and counted, and so is the result
    assert len(stages) > 30 and sum(n >= 64 for n in stages) <= 4


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def test_similar_documents_against_all_pairs(spark):
    rnd = random.Random(4)
    made = []
    for _ in range(25):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(3, 200))]
        made.append(base)
        for _ in range(rnd.randint(0, 4)):
            near = [f"w{rnd.randrange(5000)}" if rnd.random() < rnd.choice([0.0, 0.01, 0.03, 0.06]) else w for w in base]
            made.append(near)
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(made)] + [(500, None, "", "", 0), (501, "", "", "", 0), (None, " ".join(made[0]), "", "", 0), (None, "alone " * 9, "", "", 0)]
    rows.append(rows[2])
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= S.SIMILAR * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                links += 1
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        want.append((r[0], min(ids, default=None)))
    got = S.similar_documents(frame(spark, rows, clash=("t", "class", "set"))).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got) and links > 20
    assert S.similar_documents(empty(spark)).count() == 0


def test_linked_prints_meet_where_no_band_does(spark):
    """Two texts of similarity 0.8, a bit apart and alike in none of the bands: SimHash alone makes them candidates."""
    texts = [" ".join([f"b4w{k}" for k in range(12)] + [last]) for last in ("v755", "v1032")]
    x, y = (S.shingle_set(t.encode(), 5) for t in texts)
    assert not set(S.band_keys(x)) & set(S.band_keys(y)) and S.jaccard(x.tobytes(), y.tobytes()) == 0.8
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, "another text of some more words than the five of a shingle"])]
    got = S.similar_documents(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 0), (2, 2)]
    assert sorted(r["doc_id"] for r in S.one_of_each(frame(spark, rows)).collect()) == [0, 2]


def test_print_buckets_are_the_components_of_the_prints(spark):
    rnd = random.Random(12)
    prints = [rnd.getrandbits(64) for _ in range(20)]
    prints += [p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for p in prints[:12] * 3] + prints[:5]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    groups = defaultdict(set)
    for r in S.print_buckets(spark.createDataFrame(rows, "class bigint, fp bigint")).collect():
        groups[r["key"]].add(r["class"])
    assert {frozenset(g) for g in groups.values()} == brute_components(prints) and len(groups) == 20


def test_copies_inside_a_large_family(spark):
    """Texts that share a template stay below 0.8 to each other; every planted copy is in the group of its text."""
    rnd = random.Random(8)
    template = [f"t{k}" for k in range(300)]
    of = lambda base, n: [f"o{rnd.randrange(10**9)}" if k in chosen else w for chosen in [set(rnd.sample(range(300), n))] for k, w in enumerate(base)]
    family = [of(template, 5) for _ in range(260)]
    copies = [of(w, 5) for w in family[:50]]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(family + copies)]
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= S.SIMILAR * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                links += 1
    groups = defaultdict(set)
    for i in range(len(rows)):
        groups[find(i)].add(i)
    got = defaultdict(set)
    for r in S.similar_documents(frame(spark, rows)).collect():
        got[r["component_id"]].add(r["doc_id"])
    assert links >= 40 and len(groups) > 200
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values()}


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
        x, y = both[: rng.integers(1, 600)], both[rng.integers(0, 300) :]
        bits = int(np.bitwise_count((S.parity(x) ^ S.parity(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y)) and not (S.parity(x) ^ S.parity(x)).any()


def all_similar_pairs(sets, similarity):
    """By prefixes in the order of the shingles' own hashes: texts that similar share one among the least of each."""
    where, found = defaultdict(list), set()
    for i, x in enumerate(sets):
        own = sorted(map(hash, x))
        near = set()
        for h in own[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]:
            near.update(where[h])
            where[h].append(i)
        found.update((j, i) for j in near if len(x & sets[j]) >= similarity * len(x | sets[j]))
    return found


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_recall_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    group = {r["doc_id"]: r["component_id"] for r in S.similar_documents(docs).collect()}
    rows = docs.collect()
    of = {}
    for r in rows:
        of.setdefault(shingles(r["text"]), []).append(r["doc_id"])
    sets = list(of)
    pairs = all_similar_pairs(sets, S.SIMILAR)
    caught = sum(group[of[sets[i]][0]] == group[of[sets[j]][0]] for i, j in pairs)
    assert all(len({group[d] for d in ids}) == 1 for ids in of.values())
    print(f"similar pairs of different texts: {len(pairs)}, in one group: {caught}")
    assert caught >= 0.99 * len(pairs) and len(pairs) > 40
    # nothing else is grouped: as many groups as the pairs and equal texts leave
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[find(i)] = find(j)
    assert len(set(group.values())) >= len({find(i) for i in range(len(sets))})


def test_one_of_each_keeps_unlike_texts_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "o p q r s t u"), (None, "v w x y z a c"), (2, "a b c d e f g"), (3, None), (4, ""), (None, "o p q r s t u"), (5, "solo text here"), (5, "solo text here")]
    df = spark.createDataFrame([(i, t, "x", "y", "z", "u", "v") for i, t in rows], "doc_id bigint, text string, k string, t string, class string, label string, n string")
    got = S.one_of_each(df)
    assert got.schema == df.schema
    assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == sorted(repr(r) for r in [*rows[:4], rows[5], rows[8]])
    assert S.one_of_each(empty(spark)).count() == 0
