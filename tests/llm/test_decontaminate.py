import random

from quillspark.llm import decontaminate as D

from .cases import empty, frame


def distances(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return row[1:]


def test_myers():
    rnd = random.Random(5)
    for _ in range(400):
        p = [rnd.choice("abcd") for _ in range(rnd.randint(1, 70))]
        t = [rnd.choice("abcd") for _ in range(rnd.randint(0, 90))]
        assert D.myers(p, t) == distances(p, t)


def made(rnd):
    voc = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rnd.choice(voc) for _ in range(rnd.randint(1, 40)))) for k in range(6)] + [(6, None), (7, ""), (8, "... !"), (None, "a b c d e f g h i j"), (0, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    docs = []
    for d in range(150):
        t = [rnd.choice(voc) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            w = (items[rnd.randrange(6)][1]).split()
            for _ in range(rnd.randint(0, 6)):
                at = rnd.randrange(len(w) + 1)
                if rnd.random() < 0.4:
                    w.insert(at, rnd.choice(voc))
                elif at < len(w):
                    w[at : at + 1] = [] if rnd.random() < 0.5 else [rnd.choice(voc).upper()]
            at = rnd.randint(0, len(t))
            t[at:at] = w
        docs.append((d, ", ".join(t), "en", "s", 0))
    return items, [*docs, (None, docs[3][1], "", "", 0), (800, None, "", "", 0), docs[5], docs[5]]


def test_against_all_pairs(spark):
    items, docs = made(random.Random(1))
    want = []
    for i, t, *_ in docs:
        w = (t or "").lower().replace(",", "").split()
        for k, b in items:
            p = [w for w in (b or "").split() if w.isalnum()]
            if len(p) >= D.LEAST and w and (d := min(distances(p, w))) <= len(p) * D.PERCENT // 100:
                want.append((i, k, d))
    df, table = frame(spark, docs, clash=("item_id", "distance")), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (D.BLOCK, 200):
        got = D.contaminated(df, table, block=block).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:3]) for r in got)
    assert len(want) > 40


def test_place_of_the_match():
    item = "one two three four five six seven eight nine ten"
    got = D.Matcher([(1, item.encode())], 15, 8).scan(f"x y {item.replace('five', 'FIVE, and')} z".encode())
    assert got == [(0, 1, 2, 11)]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(frame(spark), items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id bigint, text string")
    assert D.contaminated(empty(spark), some).count() == 0
