import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import editdist as E
from quillspark.functions import masking as M
from quillspark.functions import text as T
from quillspark.operators.score import METRICS, dealt, score, score_distinct

WS = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def fields(text):
    return [w for w in re.split(f"[{re.escape(''.join(WS))}]+", text) if w]


def brute_mask(ref, hyp, patterns):
    if not patterns:
        return ref, hyp, 0
    ignored = sum(ref.count(p) * len(p) for p in patterns if p)
    out_ref, out_hyp, i, j = [], [], 0, 0
    while i < len(ref):
        mark = next((p for p in patterns if p and ref.startswith(p, i)), None)
        if mark is None:
            out_ref.append(ref[i])
            out_hyp += hyp[j : j + 1]
            i, j = i + 1, min(j + 1, len(hyp))
            continue
        end = i + len(mark)
        alone = (i == 0 or ref[i - 1] in WS) and (end == len(ref) or ref[end] in WS)
        if alone:
            while j < len(hyp) and hyp[j] in WS:
                j += 1
            while j < len(hyp) and hyp[j] not in WS:
                j += 1
        else:
            j = min(j + 1, len(hyp))
        i = end
    return "".join(out_ref), "".join(out_hyp), ignored


def table(a, b):
    m = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = min(m[i - 1][j - 1] + (a[i - 1] != b[j - 1]), m[i - 1][j] + 1, m[i][j - 1] + 1)
    return m


def brute_align(a, b):
    m, r, c = table(a, b), len(a), len(b)
    n = {"c": 0, "s": 0, "d": 0, "i": 0}
    while r or c:
        if r and c and a[r - 1] == b[c - 1]:
            n["c"], r, c = n["c"] + 1, r - 1, c - 1
        elif r and c and m[r][c] == m[r - 1][c - 1] + 1:
            n["s"], r, c = n["s"] + 1, r - 1, c - 1
        elif r and m[r][c] == m[r - 1][c] + 1:
            n["d"], r = n["d"] + 1, r - 1
        else:
            n["i"], c = n["i"] + 1, c - 1
    return (m[-1][-1], *n.values())


GOLDEN_MASKS = [
    ("hello world", "hello world", [], "hello world", "hello world", 0), ("hello | world", "hello foo world", ["|"], "hello  world", "hello  world", 1),
    ("hel|o", "hello", ["|"], "helo", "helo", 1), ("the | cat | jumped", "the quick cat suddenly jumped", ["|"], "the  cat  jumped", "the  cat  jumped", 2),
    ("h|l|o", "hello", ["|"], "hlo", "hlo", 2), ("| hello world", "foo hello world", ["|"], " hello world", " hello world", 1),
    ("hello world |", "hello world foo", ["|"], "hello world ", "hello world ", 1), ("hello | world , test", "hello foo world bar test", ["|", ","], "hello  world  test", "hello  world  test", 2),
    ("hello [?] world", "hello unknown world", ["[?]"], "hello  world", "hello  world", 3), ("h||o", "helo", ["|"], "ho", "ho", 2),
    ("hello | world | test", "hello foo", ["|"], "hello  world  test", "hello ", 2), ("|", "something", ["|"], "", "", 1), ("abc", "abcdef", [""], "abc", "abc", 0),
]


@pytest.mark.parametrize("case", GOLDEN_MASKS)
def test_golden_masks(spark, case):
    ref, hyp, patterns, *want = case
    assert list(brute_mask(ref, hyp, patterns)) == want
    got = spark.createDataFrame([(ref, hyp)], "ref string, hyp string").select(M.mask(F.col("ref"), F.col("hyp"), patterns).alias("m")).first()["m"]
    assert list(got) == want


@pytest.mark.parametrize("patterns", [["|"], ["|", "[?]", ""], ["ab", "a"], [" |"]])
def test_random_masks(spark, patterns):
    rnd = random.Random(str(patterns))
    rows = [tuple("".join(rnd.choice("ab| \n[?]é　😀") for _ in range(rnd.randint(0, 14))) for _ in range(2)) for _ in range(500)]
    m = M.mask(F.col("ref"), F.col("hyp"), patterns)
    for r in spark.createDataFrame(rows, "ref string, hyp string").select("ref", "hyp", m.alias("m")).collect():
        assert tuple(r["m"]) == brute_mask(r["ref"], r["hyp"], patterns), (r, patterns)


def test_distances(spark):
    rnd = random.Random(2)
    pairs = [("kitten", "sitting"), ("école", "ecole"), ("你好世界", "你好世"), ("مرحبا", "مرحبه"), ("", ""), ("a", "")]
    pairs += [tuple(" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))) for _ in range(2)) for _ in range(250)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = T.tokenize(F.col("a")), T.tokenize(F.col("b"))
    rows = df.select("a", "b", E.char_distance(F.col("a"), F.col("b")).alias("cd"), E.word_distance(a, b).alias("wd"), E.align(a, b).alias("x"), E.align_native(a, b).alias("y")).collect()
    assert [r["cd"] for r in rows[:4]] == [3, 1, 1, 1]
    for r in rows:
        want = brute_align(r["a"].split(), r["b"].split())
        assert tuple(r["x"]) == tuple(r["y"]) == want and r["wd"] == want[0]
        assert r["cd"] == table(r["a"], r["b"])[-1][-1]


def test_many_distinct_words(spark):
    words = [f"w{i}" for i in range(60000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:59000]))], "a string, b string")
    # numbers above the surrogates; prefixes alone so that the distance stays cheap
    a = F.slice(T.tokenize(F.col("a")), 56000, 300)
    got = df.select(E.word_distance(F.concat(F.slice(T.tokenize(F.col("a")), 1, 10), a), a).alias("d")).first()["d"]
    assert got == 10


def test_score_golden(spark):
    rows = [("one two three", "one too three four"), ("école\n世界", "ecole 世界"), ("a b c", ""), ("", "x"), ("", ""), ("abcde", "abXde"), ("abc", "completely different")]
    got = {r["ref"] + "/" + r["hyp"]: r["m"] for r in score(spark.createDataFrame(rows, "ref string, hyp string"), single_line=True).collect()}
    m = got["one two three/one too three four"]
    assert (m["word_distance"], m["correct_words"], m["substitutions"], m["deletions"], m["insertions"]) == (2, 2, 1, 0, 1)
    m = got["école\n世界/ecole 世界"]
    assert (m["char_distance"], m["ref_words"], m["word_error_rate"]) == (1, 2, 0.5)
    assert got["/x"]["char_accuracy"] == 1.0 and got["/x"]["word_error_rate"] == 0.0 and got["/x"]["char_similarity"] == 0.0
    assert got["/"]["char_similarity"] == 1.0 and got["/"]["word_similarity"] == 1.0
    assert got["a b c/"]["word_accuracy"] == 0.0 and got["abc/completely different"]["char_accuracy"] < 0


def test_invariants_native_and_distinct(spark):
    rnd = random.Random(6)
    rows = [tuple(" ".join(rnd.choice("ab|") for _ in range(rnd.randint(0, 9))) for _ in range(2)) for _ in range(80)]
    df = spark.createDataFrame(rows * 2, "ref string, hyp string")
    one, two, three = (f(df, ignore=("|",), **k).collect() for f, k in ((score, {}), (score, {"native": True}), (score_distinct, {})))
    key = lambda r: repr(r)
    assert sorted(one, key=key) == sorted(two, key=key) == sorted(three, key=key)
    for r in one:
        m = r["m"]
        assert m["correct_words"] + m["substitutions"] + m["deletions"] == m["ref_words"]
        assert m["correct_words"] + m["substitutions"] + m["insertions"] == m["hyp_words"]
        assert m["substitutions"] + m["deletions"] + m["insertions"] == m["word_distance"]
        assert abs(m["word_error_rate"] + m["word_accuracy"] - 1) < 1e-12
        ref, hyp, n = brute_mask(*r[:2], ["|"])
        assert m["ignored_chars"] == n and m["char_distance"] == table(ref, hyp)[-1][-1]
        assert tuple(m[c] for c in METRICS[9:13]) == brute_align(fields(ref), fields(hyp))[1:]


def test_null_texts(spark):
    got = score(spark.createDataFrame([(None, "a"), ("a", None)], "ref string, hyp string")).collect()
    assert all(r["m"]["char_distance"] is None for r in got)


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_distances_by_columns_of_bits():
    rnd = random.Random(21)
    for _ in range(600):
        a, b = ("".join(rnd.choice("abcé😀") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        d = table_distance(a, b)
        assert E.distance(a, b) == d
        dist, correct, substituted, deleted, inserted = E.align_words(list(a), list(b))
        assert dist == d == substituted + deleted + inserted and correct + substituted + deleted == len(a) and correct + substituted + inserted == len(b)


def test_long_texts_need_little_memory():
    rnd = random.Random(4)
    a, b = ([f"w{rnd.randrange(4000)}" for _ in range(12_000)] for _ in range(2))
    tracemalloc.start()
    assert E.align_words(a, b)[0] > 10_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # a table of small integers would take 576 MB


def test_spread_changes_nothing(spark):
    df = spark.createDataFrame([(i, "a b c " * i, "a c b " * i) for i in range(20)], "i int, ref string, hyp string")
    assert {(r["i"], r["m"]) for r in score(df, spread=7).collect()} == {(r["i"], r["m"]) for r in score(df).collect()}


def table_backtrace(a, b):
    """(distance, correct, substituted, deleted, inserted) from the whole table."""
    n, m = len(a), len(b)
    table = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            table[i][j] = table[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(table[i - 1][j - 1], table[i - 1][j], table[i][j - 1])
    c = s = d = x = 0
    while n and m:
        if a[n - 1] == b[m - 1]:
            n, m, c = n - 1, m - 1, c + 1
        elif table[n][m] == table[n - 1][m - 1] + 1:
            n, m, s = n - 1, m - 1, s + 1
        elif table[n][m] == table[n - 1][m] + 1:
            n, d = n - 1, d + 1
        else:
            m, x = m - 1, x + 1
    return s + d + n + x + m, c, s, d + n, x + m


@pytest.mark.parametrize("bits", [E.TABLE_BITS, 0])
def test_alignment_with_columns_made_anew(monkeypatch, bits):
    monkeypatch.setattr(E, "TABLE_BITS", bits)
    monkeypatch.setattr(E._Places, "OFTEN", 3)
    rnd = random.Random(9)
    for _ in range(1500):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 30))] for _ in range(2))
        assert E.align_words(a, b) == table_backtrace(a, b)


def test_memory_of_a_long_alignment():
    rnd = random.Random(3)
    a = [f"w{rnd.randint(0, 40_000)}" if rnd.random() < 0.8 else "the" for _ in range(60_000)]
    b = [w if rnd.random() < 0.7 else f"w{rnd.randint(0, 40_000)}" for w in a]
    tracemalloc.start()
    dist, correct, *rest = E.align_words(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and correct + rest[0] + rest[1] == 60_000 and dist == sum(rest) == E.distance(a, b)


def test_pairs_are_dealt_by_cost(spark):
    rows = [(k, "w " * 20, "w " * 19) for k in range(3000)] + [(10_000 + k, f"{k} " + "x y " * 5000, "x z " * 5000) for k in range(10)] + [(20_000, None, "a")]
    df = spark.createDataFrame(rows, "k int, ref string, hyp string").coalesce(3)
    out = dealt(df, parts=64)
    assert out.columns == df.columns and sorted(r[0] for r in out.collect()) == sorted(r[0] for r in rows)
    cells = out.select(F.spark_partition_id().alias("p"), (F.coalesce(F.length("ref"), F.lit(0)) * F.length("hyp")).alias("c")).groupBy("p").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    cost = sorted(r["c"] for r in cells)
    assert cost[-1] < 2 * cost[len(cost) // 2] and sum(r["n"] == 1 for r in cells) >= 10
    assert dealt(df.where("false")).count() == 0 and dealt(df.where("k = 20000"), parts=9).count() == 1
    even = dealt(df.where("k < 3000"), parts=8)
    assert even.rdd.getNumPartitions() == 8 and even.count() == 3000
    assert sorted(map(repr, score(df.where("k < 30"), spread=5).collect())) == sorted(map(repr, score(df.where("k < 30")).collect()))


def test_a_batch_s_tokens_are_not_all_held_at_once():
    texts = [" ".join(f"w{i}-{k}" for k in range(200)) for i in range(1500)] + [None]
    ref = pa.array(texts)
    tokens = pa.array([t and t.split() for t in texts])
    tracemalloc.start()
    got = E.compare.func(ref, ref, tokens, tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[-2:] == [dict(zip(E.COMPARISON.names, row, strict=True)) for row in ((0, 0, 200, 0, 0, 0), (None,) * 6)]
    assert E.align.func(tokens[:0], tokens[:0]).type == pa.struct([(n, pa.int32()) for n in E.ALIGNMENT.names])
    assert peak < 8 << 20, peak  # a batch's tokens at once are over 30 MB


def test_words_go_to_python_within_their_texts(spark):
    odd = "".join(map(chr, range(0x3100))) + "\U00010020 x​﻿ y\n\n"
    rows = [("a  b\tc", "a b d "), (odd, odd[::-1]), ("x\x1cy\x1fz q", "x y"), ("", " 　 "), (None, "a b"), ("a b c", None), (None, None)]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    got = score(df)
    below = got._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[1]
    assert "split(" not in below  # tokens beside the texts make an Arrow batch two and a half times as large
    names = ["ref_words", "hyp_words", "word_distance", "correct_words", "substitutions", "deletions", "insertions", "word_error_rate"]
    got = got.select("ref", "hyp", *(f"m.{c}" for c in names)).collect()
    assert [E.words(r["ref"] or "") for r in got] == [r["w"] for r in df.select(T.tokenize(F.coalesce("ref", F.lit(""))).alias("w")).collect()]
    for r in got:
        n, m = (None if r[c] is None else len(fields(r[c])) for c in ("ref", "hyp"))
        assert (r["ref_words"], r["hyp_words"]) == (n, m)
        assert None in r[:2] or tuple(r[c] for c in names[2:7]) == E.align_words(fields(r["ref"]), fields(r["hyp"]))
    assert got[4]["word_error_rate"] is None and got[4]["hyp_words"] == 2 and got[5]["ref_words"] == 3
