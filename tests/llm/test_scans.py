"""Secret and license scans."""

import hashlib
import math
import random
import re
import time

import pytest

from quillspark.llm import licenses, queries
from quillspark.llm.automaton import Automaton
from quillspark.llm.secrets import BASE_RULES, Scanner, code_points, scan_secrets

from .cases import empty, frame

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out)


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["token", "=", " ", ":", '"', "'", "AKIA", "abcdef0123456789", "api_key", "APIKEY", "secret", "é", "x", "A1", "Password", ".", "-", "0a", "AKIAB", "ghp_", "eyJ", "-----BEGIN RSA PRIVATE KEY-----", "\n", "😀"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def test_base_spans_equal_regexes():
    scanner = Scanner()
    for t in random_texts(4000):
        data = t.encode()
        assert [s for s in code_points(data, scanner.spans(data)) if s[1] < len(BASE_RULES)] == brute(t), t


MORE = {
    "github": ("gh[pousr]_[A-Za-z0-9]+", 40),
    "google": ("AIza[A-Za-z0-9_-]+", 39),
    "slack": ("xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]*", 20),
    "jwt": ("eyJ[A-Za-z0-9_-][A-Za-z0-9_.-]*", 40),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
}


def test_added_spans_equal_regexes():
    scanner, rnd = Scanner(), random.Random(9)
    parts = ["ghp_", "gho_", "AIza", "xoxb-", "xoxp-", "a1B2" * 9, "Zz9" * 12, "-", "_", " ", "é", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "x" * 20, "😀", "AIz", "gh", ".", "eyJ", "eyJhb"]
    found = 0
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        data = text.encode()
        got = code_points(data, scanner.spans(data))
        for k, rule in enumerate(scanner.rules):
            if rule.kind in MORE:
                pattern, least = MORE[rule.kind]
                want = [m.span() for m in re.finditer(pattern, text, re.ASCII) if m.end() - m.start() >= least]
                assert [(s, e) for s, j, e in got if j == k] == want, (rule.kind, text)
                found += len(want)
    assert found > 500


def test_many_hits_in_a_long_text_take_time_in_proportion():
    data = ("token = abcdefghijkl " * 250_000).encode()
    scanner, began = Scanner(), time.time()
    assert len(scanner.spans(data)) == 250_000
    assert time.time() - began < 30
    assert len(scanner.spans(b"a" * 5_000_000)) == 1 and time.time() - began < 60


def test_more_rules():
    text = f"a ghp_{'x' * 36} b AIza{'q' * 35} c xoxb-{'1x' * 10} eyJ{'ax' * 25}.b é -----BEGIN OPENSSH PRIVATE KEY-----"
    kinds = [Scanner().rules[k].kind for _, k, _ in Scanner().spans(text.encode())]
    assert kinds == ["github", "google", "slack", "jwt", "pem"]


def test_automaton_is_minimal_and_equals_regex():
    for pattern in ("(ab|a)*c?", "a{2,3}[b-d]+", "x|xy|xyz", "[^a]b"):
        dfa = Automaton([pattern])
        rnd = random.Random(2)
        for _ in range(500):
            t = "".join(rnd.choice("abcdxyz") for _ in range(rnd.randint(0, 6)))
            state = dfa.start
            for b in t.encode():
                state = dfa.next[state][b] if state >= 0 else -1
            assert bool(state >= 0 and dfa.accepts[state]) == bool(re.fullmatch(pattern, t)), (pattern, t)
    assert len(Automaton(["x|xy|xyz"]).accepts) == 4


def test_query_digest(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(random_texts(300, 5))] + [(None, None, None, None, None)] * 2
    frame(spark, rows, clash=("found", "kind")).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op10_secret_scan(spark, str(tmp_path)).collect():
        text = dict((a, b) for a, b, *_ in rows)[r["doc_id"]] or ""
        spans = brute(text)
        said = ",".join(f"{BASE_RULES[k].kind}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))


def test_empty_tables(spark):
    assert scan_secrets(empty(spark)).count() == 0
    assert licenses.scan_licenses(empty(spark)).count() == 0


def brute_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_query(spark, tmp_path):
    rnd = random.Random(3)
    parts = ["MIT", "license", "License,", "apache", "General", "public", "gnu", "é", "a.b", "\n", "x", *(t for _, t, _ in licenses.TEMPLATES)]
    made = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(300)] + [None, ""]
    frame(spark, [(i, t, "", "", 0) for i, t in enumerate(made)], clash=("labels",)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op4_license_scan(spark, str(tmp_path)).collect()
    assert len(rows) == len(made)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(made[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_templates_are_found_and_reworded_ones_are_not():
    index = licenses.Index()
    for label, text, _ in licenses.TEMPLATES:
        found = index.scan(f"some words before\n{text.upper()}. and after".encode())
        assert label in found["labels"] and found["score"] > 0.6, text
    assert not index.scan(b"licensed by way of cc in nc 4 0, hereby granted")["labels"]


def test_written_out_licences():
    index = licenses.Index()
    for text, labels in (
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", {"isc"}),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", {"lgpl"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa"}),
        ("The quick brown fox was granted a public license to jump without restriction over the software.", set()),
    ):
        assert index.scan(text.encode())["labels"] == labels, text


def brute_labels(text):
    """Every template at every shift, by the rules as they are written."""
    w = licenses.words_of((text or "").encode()).split()
    split = [(label, licenses.words_of(t.encode()).split(), [licenses.words_of(p.encode()).split() for p in phrases]) for label, t, phrases in licenses.TEMPLATES]
    weight = lambda x: math.log(1 + len(split) / sum(x in t for _, t, _ in split))
    holds = lambda words, p: any(words[i : i + len(p)] == p for i in range(len(words)))
    labels, score = set(), 0.0
    for label, template, phrases in split:
        own = sorted(set(template) & set(w), key=lambda x: (-weight(x), x))[: licenses.RAREST]
        for shift in range(-len(template), len(w)):
            there = {x for k, x in enumerate(template) if 0 <= shift + k < len(w) and w[shift + k] == x}
            n = len(there & set(own))
            near = w[max(0, shift) : max(0, shift + len(template))]
            if n >= max(2, licenses.LEAST_SHARE * len(own)) and all(holds(near, p) for p in phrases):
                labels.add(label)
                same = sum(weight(x) for k, x in enumerate(template) if 0 <= shift + k < len(w) and w[shift + k] == x)
                score = max(score, min(1.0, same / sum(map(weight, template))))
    return labels, score


def test_labels_and_score_against_every_alignment():
    rnd, index, found = random.Random(14), licenses.Index(), 0
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            t = rnd.choice([x for x in licenses.TEMPLATES if len(x[1].split()) > 3])[1].split()
            for _ in range(rnd.randint(0, 5)):
                at = rnd.randrange(len(t) or 1)
                t[at : at + 1] = rnd.choice([[], ["other"], [t[at], "more"]])
            parts += [*t[rnd.randint(0, 3) :], *(["filler", "the"] * rnd.randint(0, 3))]
        text = " ".join(parts)
        got, (labels, score) = index.scan(text.encode()), brute_labels(text)
        assert got["labels"] == labels, text
        assert abs(got["score"] - (max(score, 0.5) if got["base"] else score)) < 1e-9
        found += bool(labels)
    assert found > 60


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("// SPDX-License-Identifier: MIT\nint main() {}", {"mit"}),
        ("# SPDX-License-Identifier: GPL-2.0-only", {"gpl"}),
        ("Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").", {"epl"}),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", {"cc-by"}),
        ("See https://creativecommons.org/licenses/by/4.0/ for the terms", {"cc-by"}),
        ("See https://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa"}),
        ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation", {"gfdl"}),
        ("covered by the GNU Library General Public License version 2", {"gpl", "lgpl"}),  # the base scan finds its words too
        ("why the cc by 4 0 label is confusing", set()),
        ("text under CC BY 4.0", {"cc-by"}),
        ("an spdx license identifier says which license holds", set()),
    ],
)
def test_notices_of_other_forms(text, labels):
    got = licenses.Index().scan(text.encode())
    assert got["base"] | got["labels"] == labels
