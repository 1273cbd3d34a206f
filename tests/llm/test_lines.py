import random

from quillspark.llm.lines import GRAM, LEAST, dedup_lines

from .cases import empty, frame, texts, words


def split(text):
    return [(i, line) for i, line in enumerate((text or "").split("\n")) if line.split()]


def brute(rows):
    """Lines in a run of LEAST words and more that stands earlier: all windows of that size that end or begin at a line."""
    seen, gone = set(), {}
    for key in sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None}):
        lines = split(key[2])
        size = [len(x.split()) for _, x in lines]
        found = set()
        for i in range(len(lines)):
            for step in (1, -1):
                total, j = 0, i
                while 0 <= j < len(lines):
                    total += size[j]
                    if total >= LEAST:
                        found.add((min(i, j), max(i, j)))
                        break
                    j += step
        lost = set()
        # a window counts as seen from the place after its first line on, so that repeats within a text are found too
        for a, b in sorted(found):
            content = tuple(x for _, x in lines[a : b + 1])
            if content in seen:
                lost |= set(range(a, b + 1))
            seen.add(content)
        gone[key] = {lines[i][0] for i in lost}
    return gone


def test_passages_go_and_the_first_stays(spark):
    rnd = random.Random(2)
    passage = "\n".join(words(rnd, 20, 10**6) for _ in range(4))
    one_line = words(rnd, 55, 10**6)
    own = lambda n: words(rnd, n, 10**6)
    made = [f"{own(30)}\n{passage}\n{own(5)}", f"{passage}\n{own(30)}", f"{own(9)}\n\n{passage}", own(70), f"{own(3)}\n{one_line}", f"{one_line}\n{own(40)}", f"{one_line}\n{one_line}", None, ""]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(made)]
    got = {r["doc_id"]: r for r in dedup_lines(frame(spark, rows, clash=("n_removed", "k", "pos", "gone"))).collect()}
    gone = brute(rows)
    for i, t in enumerate(made):
        lost = gone.get((True, i, t), set())
        assert got[i]["n_removed"] == len(lost), i
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
        assert got[i]["text"] == want
    assert got[0]["n_removed"] == 0 and got[1]["text"] == made[1].split("\n")[-1] and got[6]["text"] == ""


def test_against_all_windows(spark):
    rnd = random.Random(5)
    pool = [words(rnd, rnd.choice([1, 3, 8, 20, 30, 60]), 10**6) for _ in range(60)]
    runs = [[rnd.choice(pool) for _ in range(rnd.randint(2, 6))] for _ in range(12)]
    made = []
    for _ in range(120):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += rnd.choice(runs) if rnd.random() < 0.6 else [words(rnd, 12, 10**6)]
        made.append("\n".join(parts))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(made)]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(frame(spark, rows)).collect()}
    want = {k[1]: len(v) for k, v in brute(rows).items()}
    assert sum(want.values()) > 200
    assert got == want  # none missed, none more


def test_odd_rows(spark):
    rows = texts()
    got = dedup_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["text"] is None for r in got) == sum(r[1] is None for r in rows)
    had = [(r[0], r[1]) for r in rows]
    assert all((r["doc_id"], r["text"]) in had for r in got if r["n_removed"] == 0)
    assert dedup_lines(empty(spark)).count() == 0 and GRAM * 2 == LEAST


def test_plan_has_no_python(spark):
    plan = dedup_lines(frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_no_run_is_missed(spark):
    """A frequent run hides no other: the gram's first place stands in another context than the later copies."""
    rnd = random.Random(9)
    own = lambda n: words(rnd, n, 10**6)
    frequent, a, b = own(30), own(30), own(30)
    made = [f"{own(9)}\n{frequent}\n{own(40)}" for _ in range(3)]
    made += [f"{own(9)}\n{frequent}\n{a}\n{own(9)}", f"{own(7)}\n{frequent}\n{a}\n{own(7)}", f"{b}\n{frequent}\n{own(5)}", f"{own(3)}\n{b}\n{frequent}\n{own(8)}"]
    pool = [own(rnd.choice([1, 3, 8, 20, 30, 60])) for _ in range(60)]
    runs = [[rnd.choice(pool) for _ in range(rnd.randint(2, 6))] for _ in range(12)]
    for _ in range(120):
        made.append("\n".join(x for _ in range(rnd.randint(1, 4)) for x in (rnd.choice(runs) if rnd.random() < 0.6 else [own(12), " "])))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(made)]
    gone = {k[1]: v for k, v in brute(rows).items()}
    assert all(len(gone[i]) == (i in (4, 6)) * 2 for i in range(7)) and sum(map(len, gone.values())) > 200
    for r in dedup_lines(frame(spark, rows)).collect():
        i = r["doc_id"]
        assert r["text"] == "\n".join(x for k, x in enumerate(made[i].split("\n")) if k not in gone[i]) and r["n_removed"] == len(gone[i])
