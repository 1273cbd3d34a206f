import random
import re
import time

import numpy as np
import pytest

from quillspark.llm import repetition as R

from .cases import empty, frame, texts


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)

    def covered(k):
        places = {}
        for i in range(n - k + 1):
            places.setdefault(tuple(w[i : i + k]), []).append(i)
        return {i + j for v in places.values() if len(v) > 1 for i in v for j in range(k)}, places

    repeats, _ = covered(5)
    long_ones, places = covered(R.MIN_REPEAT)
    longest = 0
    for v in places.values():
        for a in range(len(v)):
            for b in range(a):
                k = 0
                while v[a] + k < n and w[v[b] + k] == w[v[a] + k]:
                    k += 1
                longest = max(longest, k)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < 10 or 100 * len(repeats) > 20 * n
    kept = not failed and 100 * len(long_ones) <= R.MAX_COVERED_PERCENT * n and longest <= R.MAX_LONGEST
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeats), failed, kept, len(long_ones), longest)


def test_features_and_verdicts(spark):
    df = frame(spark, clash=("KEPT", "n_words"))
    got = R.quality(df)
    assert "KEPT" not in got.columns and len(set(map(str.lower, got.columns))) == len(got.columns)
    rows = got.collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert tuple(r[c] for c in R.FEATURES) == brute(r["text"]), r["doc_id"]


@pytest.mark.parametrize("alphabet", ["ab", "abc", "a"])
def test_suffix_arrays_on_repetitive_texts(alphabet):
    rnd = random.Random(len(alphabet))
    made = [" ".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 70))) for _ in range(150)]
    f = R.judge([t.encode() for t in made])
    for i, t in enumerate(made):
        assert tuple(f[c][i] for c in R.FEATURES) == brute(t), t


def test_groups_of_texts_do_not_meet(monkeypatch):
    monkeypatch.setattr(R, "GROUP", 50)
    made = [t or "" for _, t, *_ in texts(4)]
    f = R.judge([t.encode() for t in made])
    assert [tuple(f[c][i] for c in R.FEATURES) for i in range(len(made))] == [brute(t) for t in made]


def test_long_repeat_fails_though_little_is_covered():
    rnd = random.Random(9)
    part = " ".join(f"p{rnd.random()}" for _ in range(80))
    rest = lambda: " ".join(f"q{rnd.random()}" for _ in range(500))
    f = R.judge([f"{rest()} {part} {rest()} {part} {rest()}".encode()])
    assert not f["base_failed"][0] and not f["kept"][0] and f["longest_repeat"][0] == 80


def test_empty_table(spark):
    assert R.quality(empty(spark)).count() == 0


def test_short_repeats_are_found_without_repeated_windows():
    f = R.judge([b"a b c x a b c y d e f g", b"a b x a b y c"], min_repeat=3)
    assert f["n_covered_words"].tolist() == [6, 0] and f["longest_repeat"].tolist() == [3, 0] and f["n_repeat_words"].tolist() == [0, 0]
    assert R.judge([b"a b x a b y c"], min_repeat=2)["n_covered_words"].tolist() == [4]


def test_intervals_against_all_ranges():
    rnd = random.Random(12)
    for _ in range(300):
        lcp = np.array([0, *(rnd.choice([0, 1, 2, 3, 4]) for _ in range(rnd.randint(1, 25)))])
        n, want = len(lcp), set()
        for first in range(n):
            for last in range(first + 1, n):
                value = int(lcp[first + 1 : last + 1].min())
                if value >= 2 and (first == 0 or lcp[first] < value) and (last == n - 1 or lcp[last + 1] < value):
                    want.add((value, first, last))
        got = [tuple(r) for r in R.lcp_intervals(lcp, 2).tolist()]
        assert set(got) == want and len(got) == len(want)


def test_maximal_repeats_are_maximal():
    w = "x a b c d y a b c d z b c d".split()
    ids = np.array([ord(c) for c in w])
    starts, lengths = R.maximal_repeats(ids, np.zeros(len(ids), np.int64), 3)
    assert sorted(zip(starts.tolist(), lengths.tolist(), strict=True)) == [(1, 4), (2, 3), (6, 4), (7, 3), (11, 3)]


def test_one_word_over_and_over_takes_seconds():
    began = time.time()
    f = R.judge([b"a " * 200_000, b"a b " * 100_000])
    assert f["n_covered_words"].tolist() == [200_000, 200_000] and time.time() - began < 60
