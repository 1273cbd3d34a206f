"""The divergence audit against plain counting, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quillspark.llm import divergence as D
from quillspark.llm import queries

from .cases import empty, frame, texts


def expected(rows, least, top=D.TOP):
    read = [tuple(v or "" for v in (lang, source, text)) for _, text, lang, source, *_ in rows]
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(small)) for *_, t in read]
    docs, counts = Counter(), defaultdict(Counter)
    for (lang, source, _), found in zip(read, terms, strict=True):
        counts[lang, source].update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {r[0] for r in read}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        own = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(c):
            total = sum(c[t] for t in kept) + D.SMOOTHING * len(kept)
            return {t: 1 + D.SCALE * (c[t] + D.SMOOTHING) // total for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def made(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "the", "é", "É", "x_y", "你好", "don't", "Zebra", "1st", "q\x00r"]
    rows = []
    for k in range(120):
        text = " ".join(vocabulary[int(len(vocabulary) * rnd.random() ** 2)] for _ in range(rnd.randint(0, 30)))
        rows.append((k % 50, rnd.choice([text, text, None if k % 17 == 0 else text]), rnd.choice(["en", "en", "de", "", None]), rnd.choice(["s1", "s1", "s1", "S2", "é", None, "ß"]), 0))
    return [*rows, rows[0], rows[0], (None, "only once", "xx", "lone", 0), (None, "", "yy", "a", 0), (None, "!", "yy", "b", 0)]


def got(df, **more):
    return sorted(tuple(r) for r in D.audit(df, **more).collect())


@pytest.mark.parametrize(("seed", "least"), [(1, 5), (2, 1), (3, 40)])
def test_against_counting(spark, monkeypatch, seed, least):
    rows = made(seed)
    df = frame(spark, rows, clash=("term", "n", "total", "v", "part", "item", "value", "rank", "s", "o"))
    assert got(df, least=least) == expected(rows, least)
    assert got(df, least=least, top=3) == expected(rows, least, 3)


def test_small_blocks():
    """Tasks that let their counts go early and tally few rows at a time find the same."""
    import pyarrow as pa

    rnd = random.Random(4)
    cells = sorted({(rnd.choice("xy"), f"t{rnd.randint(0, 40)}", f"s{rnd.randint(0, 6)}"): rnd.randint(1, 4) for _ in range(400)}.items())
    want = Counter((k[0], k[2], j[2], n, m) for i, (k, n) in enumerate(cells) for j, m in cells[i + 1 :] if k[:2] == j[:2])
    table = pa.table({c: [k[x] for k, _ in cells] for x, c in enumerate(("lang", "term", "source"))} | {"n": [n for _, n in cells]})
    for block, pairs, size in ((1 << 16, 1 << 20, 1000), (7, 5, 3), (1, 1, 1)):
        with pytest.MonkeyPatch.context() as held:
            held.setattr(D, "BLOCK", block)
            held.setattr(D, "PAIRS", pairs)
            found = Counter()
            for b in D._tally(iter(table.to_batches(max_chunksize=size))):
                for r in b.to_pylist():
                    found[r["lang"], r["s"], r["o"], r["a"], r["b"]] += r["m"]
        assert found == want
    docs = pa.RecordBatch.from_pydict({"lang": ["a", "a", "b"], "source": ["s", "s", "s"], "text": ["x y x", "Y z", "x"]})
    with pytest.MonkeyPatch.context() as held:
        held.setattr(D, "HELD", 1)
        found = Counter()
        for b in D._partial_counts(iter([docs])):
            for r in b.to_pylist():
                found[r["lang"], r["term"], "n"] += r["n"]
                found[r["lang"], r["term"], "docs"] += r["docs"]
    assert found == {("a", "x", "n"): 2, ("a", "x", "docs"): 1, ("a", "y", "n"): 2, ("a", "y", "docs"): 2, ("a", "z", "n"): 1, ("a", "z", "docs"): 1, ("b", "x", "n"): 1, ("b", "x", "docs"): 1}


def test_odd_rows(spark):
    assert got(frame(spark), least=3) == expected(texts(), 3)
    assert got(empty(spark)) == []


def test_huge_counts(spark):
    """Shares of counts that leave 64 bits when multiplied."""
    row = spark.sql("SELECT 4000000000000 AS n, 9000000000000 AS total, 1000 AS v")
    assert row.select(D._share("n", "total", "v", 5, D.SCALE)).first()[0] == 1 + D.SCALE * (4 * 10**12 + 5) // (9 * 10**12 + 5000)


def test_query_against_sql(spark):
    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = db.sql(queries.oracle_sql()["op11_source_divergence"])
    have = queries.op11_source_divergence(spark, data)
    assert have.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"
    at = [want.columns.index(c) for c in have.columns]
    assert sorted(tuple(r) for r in have.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
