"""The prefix trie against a trie of nested dictionaries, and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import prefix_trie as T
from quillspark.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, s string, pos string, k string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def conversations(rows, splice):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    if not splice:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def expected(rows, splice=True):
    convs = conversations(rows, splice)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for seq in sorted(members, key=len, reverse=True):
        kids = [k for k in out if len(k) == len(seq) + 1 and k[:-1] == seq]
        saved = sum(out[k][6] for k in kids) + (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0)
        ends = ",".join(str(c) for c in sorted(members[seq]) if len(convs[c]) == len(seq))
        parent = min(members[seq[:-1]]) if seq else None
        out[seq] = (min(members[seq]), len(seq), parent, len(members[seq]), len(kids), sum(out[k][5] for k in kids) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def splice(turns):
    c = F.col("c")
    return T.spliced(turns, c - c % 100, F.crc32(c.cast("string")) % 6, 5)


def got(df, **more):
    found = T.prefix_trie(df, **more)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(60):
        c = rnd.choice([0, 1, 2, 3, 50, 99, 100, 101, 150, 207, 208, 209, 399, 1000, 1001, 12345])
        for _ in range(rnd.randint(1, 3)):
            rows.append((c, rnd.choice([None, 0, 1, 1, 2, 5]), rnd.choice(["user", "bot", None]), rnd.choice(["a", "", None, "é 😀", "hello\nthere"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dictionaries(spark, seed):
    rows = [*made(seed), (None, 0, "user", "lost")]
    df = frame(spark, rows)
    assert got(df, copied=splice) == expected(rows)
    assert got(df) == expected(rows, splice=False)


def test_long_shared_stretches_copies_and_prefixes(spark):
    """Stretches that rounds go through several turns at a time, sequences that end inside of them, groups of copies."""
    long = [(k, "user", f"turn {k}") for k in range(40)]
    rows = []
    for c, turns in {
        10: long, 11: long[:37] + [(37, "user", "other"), (38, "user", "end")], 12: long[:20], 13: long[:20], 14: long[:21] + [(21, "bot", "x")], 15: long,
        16: [(0, "user", "else")], 17: [(0, "user", "else"), (1, "user", "more")], 18: [(0, "user", "else")], -5: [(0, "bot", "")],
        **{1000 + k: long[:3] for k in range(450)},
    }.items():
        rows += [(c, *t) for t in turns]
    df = frame(spark, rows)
    jobs = []
    found = got(df)
    assert found == expected(rows, splice=False)
    assert max(r[3] for r in found if r[1] == 3) == 456 and not jobs


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, k // 2, "user", f"t{k % 11}") for k in range(3000)] + [(8, 0, "user", "t0")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        turns = T.ordered(frame(spark, rows), "conv_id", "turn", "role", "text").orderBy("c", "pos").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mine = [r for r in turns if r["c"] == 7]
    assert [r["pos"] for r in mine] == list(range(1, 3001))
    want = sorted((k // 2, digest("user", f"t{k % 11}")[:16], len(f"t{k % 11}")) for k in range(3000))
    assert [bytes(r["digest"]) for r in mine] == [w[1] for w in want]
    total = 0
    for r, w in zip(mine, want, strict=True):
        total += w[2]
        assert r["upto"] == total


def test_few_rows(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(None, 1, "a", "b")])) == []
    for rows in ([(5, 0, "u", "hi")], [(205, 0, "u", "hi")], [(5, 0, "u", "hi"), (6, 0, "u", "hi")]):
        assert got(frame(spark, rows)) == expected(rows, splice=False)
        assert got(frame(spark, rows), copied=splice) == expected(rows)


def test_query_against_sql(spark):
    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = db.sql(queries.oracle_sql()["op12_prefix_trie"])
    have = queries.op12_prefix_trie(spark, data)
    at = [want.columns.index(c) for c in have.columns]
    assert sorted((tuple(r) for r in have.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
