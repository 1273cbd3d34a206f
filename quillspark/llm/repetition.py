"""Quality rules: repetition by suffix arrays.

A text's words are numbered and its suffixes sorted by prefix doubling. Texts without a repeated window of
``MIN_REPEAT`` words, which a hash tells, have no repeat to offer and aren't sorted. Neighbouring suffixes give the longest
common prefixes; the intervals of the LCP array whose suffixes are preceded by different words are the maximal repeated
substrings. Their spans' union over the words is the covered share, the largest value the longest repeat. A text fails if
either passes its limit, or if it fails the base rules (too few words, or too many of its words in windows that occur again).

Null text is empty text: no words, so it fails. Ties and repeated rows need no rule, each row is judged alone. No rows give no rows.
Everything is bounded by one text: batches of texts are split into groups of at most ``GROUP`` words, or one text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import record_batch, text_bytes, without

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: The method's limits: words covered by maximal repeats of MIN_REPEAT words and more, and the longest such repeat.
MIN_REPEAT = 8
MAX_COVERED_PERCENT = 20
MAX_LONGEST = 60
GROUP = 1 << 18
_SPACE = b" \t\n\r\x0b\x0c"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_windows(ids: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that occur again in their text, and a number for each that only equal ones share."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = doc[:n] == doc[window - 1 :]
    own = _mixed(ids.astype(np.uint64) + _MIX)
    h = doc[:n].astype(np.uint64)
    for k in range(window):
        h = h * _MIX + own[k : k + n]
    at = np.flatnonzero(inside)
    h = _mixed(h[at])
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    slot = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    at = at[twice[slot] == h]
    # exact: equal words, not just equal hashes
    keys = np.column_stack([doc[at], *[ids[at + k] for k in range(window)]])
    _, number, copies = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
    number = number.reshape(-1)
    keep = copies[number] > 1
    return at[keep], number[keep].astype(np.int64)


def suffix_order(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the texts side by side, and the LCP in words of each suffix with its predecessor.

    Prefix doubling; after each step only suffixes that still share their rank are sorted again. The ranks of every
    step are kept: equal ranks at step h mean equal prefixes of h words, which gives the LCPs without a scan.
    A suffix ends with its text, and suffixes of different texts share nothing.
    """
    n = len(ids)
    sa = np.lexsort((ids, doc))
    a, b = doc[sa], ids[sa]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[n] = -1
    levels, step = [], 1
    while True:
        levels.append((step, rank.copy()))
        ends = np.append(first[1:], True)
        active = np.flatnonzero(~(first & ends))  # places in the array, in runs of equal rank
        if not len(active):
            break
        at = sa[active]
        to = np.minimum(at + step, n)
        key = np.where((to < n) & (doc[np.minimum(to, n - 1)] == doc[at]), rank[to], -1)
        group = rank[at]
        order = np.lexsort((key, group))
        at, key, group = at[order], key[order], group[order]
        sa[active] = at
        first[active] = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        rank[at] = np.maximum.accumulate(np.where(first[active], active, 0))
        step *= 2
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(doc[sa[1:]] == doc[sa[:-1]]) + 1
    x, y = sa[live - 1].copy(), sa[live].copy()
    for size, ranks in reversed(levels):
        same = ranks[x] == ranks[y]
        same &= (x < n) & (y < n)
        x, y = np.minimum(x + size * same, n), np.minimum(y + size * same, n)
        lcp[live] += size * same
    return sa, lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """Rows (value, first, last): suffixes first to last of the array share ``value`` >= ``least`` words, their neighbours on either side don't.

    One pass with a stack over the places where the LCP is large enough; intervals are nested or apart, and no more than suffixes.
    """
    out, stack = [], []  # open intervals as (value, first), values rising
    before = -2
    for i in np.flatnonzero(lcp >= least).tolist():
        if i != before + 1:
            out += [(v, f, before) for v, f in reversed(stack)]
            stack = []
        first, value = i - 1, int(lcp[i])
        while stack and stack[-1][0] > value:
            v, first = stack.pop()
            out.append((v, first, i - 1))
        if not stack or stack[-1][0] < value:
            stack.append((value, first))
        before = i
    out += [(v, f, before) for v, f in reversed(stack)]
    return np.array(out, np.int64).reshape(-1, 3)


def maximal_repeats(ids: np.ndarray, doc: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of occurrences of maximal repeated substrings of ``least`` words or more.

    An LCP interval is a maximal repeat if its suffixes have different words before them (a text's beginning is unlike any).
    At each place the longest one is given; shorter ones there lie inside it. Only texts with a repeated window of
    ``least`` words are sorted.
    """
    at, _ = repeated_windows(ids, doc, least)
    if not len(at):
        return at, at
    where = np.flatnonzero(np.isin(doc, np.unique(doc[at])))
    ids, doc = ids[where], doc[where]
    sa, lcp = suffix_order(ids, doc)
    intervals = lcp_intervals(lcp, least)
    begins = np.concatenate([[True], doc[1:] != doc[:-1]])
    left = np.where(begins[sa], -1 - sa, ids[np.maximum(sa - 1, 0)])
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    intervals = intervals[changes[intervals[:, 2]] > changes[intervals[:, 1]]]
    intervals = intervals[np.argsort(-intervals[:, 0], kind="stable")]
    # longest first; places that have theirs are stepped over
    length: dict[int, int] = {}
    following: dict[int, int] = {}
    for value, first, last in intervals.tolist():
        r, seen = first, []
        while r <= last:
            if r in following:
                seen.append(r)
                r = following[r]
            else:
                length[r] = value
                following[r] = r + 1
                seen.append(r)
                r += 1
        for k in seen:
            following[k] = r
    places = sa[np.fromiter(length, np.int64, len(length))]
    return where[places], np.fromiter(length.values(), np.int64, len(length))


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:n] > 0


def judge(texts: list[bytes], min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> dict[str, np.ndarray]:
    """Features and verdicts of texts given as UTF-8 bytes."""
    m = len(texts)
    f = {k: np.zeros(m, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")}
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    group: list[np.ndarray] = []
    first, held = 0, 0

    def flush(last: int) -> None:
        nonlocal first, held
        if held:
            ids = np.concatenate(group)
            sizes = f["n_words"][first:last]
            doc = np.repeat(np.arange(last - first), sizes)
            at, _ = repeated_windows(ids, doc, WINDOW)
            if len(at):
                hit = _covered(at, np.full(len(at), WINDOW), len(ids))
                f["n_repeat_words"][first:last] = np.bincount(doc[hit], minlength=last - first)
            if len(at) or min_repeat < WINDOW:  # a longer repeat has windows that occur again
                at, length = maximal_repeats(ids, doc, min_repeat)
                if len(at):
                    hit = _covered(at, length, len(ids))
                    f["n_covered_words"][first:last] = np.bincount(doc[hit], minlength=last - first)
                    np.maximum.at(f["longest_repeat"], first + doc[at], length)
        group.clear()
        if len(numbers) > GROUP // 2:  # numbers need to last for one group only
            numbers.clear()
        first, held = last, 0

    for i, data in enumerate(texts):
        words = data.split()
        if held and held + len(words) > GROUP:
            flush(i)
        group.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        held += len(words)
        f["n_words"][i] = len(words)
        solid = data.translate(None, _SPACE)
        f["word_chars"][i] = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
        f["n_symbols"][i] = len(solid) - len(solid.translate(None, b"#*$%&|<>"))
        if b"\n" in data:
            lines = [line for line in data.split(b"\n") if line.strip()]
            f["n_dup_lines"][i] = len(lines) - len(set(lines))
    flush(m)
    n = f["n_words"]
    f["base_failed"] = (n < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    f["kept"] = ~f["base_failed"] & (100 * f["n_covered_words"] <= max_covered * n) & (f["longest_repeat"] <= max_longest)
    return f


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat")


def quality(df: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """``df`` with the features and ``kept`` for each row; columns of those names in ``df`` are replaced."""
    df = without(df, *FEATURES)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.BooleanType() if c in ("base_failed", "kept") else T.LongType()) for c in FEATURES]])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                f = judge(text_bytes(batch, text_col), **limits)
                yield record_batch(**{n: batch.column(i) for i, n in enumerate(batch.schema.names)}, **{c: pa.array(f[c]) for c in FEATURES})

    return df.mapInArrow(run, schema)
