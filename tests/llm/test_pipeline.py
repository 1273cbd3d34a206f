import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillspark.llm.decontaminate import LEAST, PERCENT

from .cases import SCHEMA, words
from .test_decontaminate import distances
from .test_repetition import brute as quality
from .test_simhash import shingles


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(11)
    items = [(k, words(rnd, 30, 10**5)) for k in range(4)]
    passage = words(rnd, 60, 10**5)
    docs = [f"{words(rnd, 70, 10**5)}\n{words(rnd, 40, 10**5)}" for _ in range(30)]
    docs += [f"{words(rnd, 50, 10**5)}\n{passage}\n{words(rnd, 20, 10**5)}" for _ in range(3)]
    docs += [docs[2], docs[4].replace("\n", " \n"), docs[7].replace("\n", " ") + " added", f"{words(rnd, 40, 10**5)} {items[1][1]} {words(rnd, 9, 10**5)}", "too short", " ".join(["the same again"] * 30), None, ""]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], items


def test_stages(spark, made, tmp_path):
    rows, items = made
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = P.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    have = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert have == {i: t for i, t, *_ in rows if quality(t)[6]}

    lines = P.line_dedup(spark, kept, str(tmp_path))
    left = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in left.values())
    assert set(left) == set(have) - {33}  # the exact copy is used up
    assert all(left[i]["text"] == have[i] for i in range(31)) and len(left[31]["text"].split()) == 70

    single = P.near_dedup(spark, lines, str(tmp_path))
    ids = sorted(left)
    sets = {i: shingles(left[i]["text"]) for i in ids}
    near = {i: [j for j in ids if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in ids}
    assert sorted(r["doc_id"] for r in single.collect()) == [i for i in ids if not near[i]] and any(near.values())

    clean = P.decontaminate(spark, single, str(tmp_path))
    want = []
    for r in single.collect():
        w = r["text"].split()
        if not any(min(distances(p.split(), w)) <= len(p.split()) * PERCENT // 100 for _, p in items if len(p.split()) >= LEAST):
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(want) and len(want) == single.count() - 1

    packed = P.run(spark, str(tmp_path))
    assert sorted(r[0] for r in packed.select("doc_id").distinct().collect()) == sorted(want)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [(None, "a b c d e f g h i j k l m", None, None, None), (None, None, None, None, None), (1, "n o p q r s t u v w x y z", "en", "s", 3), (1, "n o p q r s t u v w x y z", "en", "s", 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(repr(r["doc_id"]) for r in P.run(spark, str(tmp_path)).collect()) == ["1", "None"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_unlike_texts_under_one_id(spark, tmp_path):
    rnd = random.Random(3)
    item = words(rnd, 30, 10**5)
    clean = [words(rnd, 60, 10**5) for _ in range(4)]
    rows = [(i, t, "en", "s", len(t)) for i, t in [(None, clean[0]), (None, clean[1]), (1, clean[2]), (1, clean[3]), (None, f"{clean[0]} more"), (1, f"{item} {words(rnd, 40, 10**5)}"), (None, f"{words(rnd, 40, 10**5)} {item}")]]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    single = P.near_dedup(spark, docs, str(tmp_path))
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    one_of = {(None, clean[0]), (None, f"{clean[0]} more")}
    assert len(left) == 6 and len(one_of & set(left)) == 1 and set(left) | one_of == {r[:2] for r in rows}
    kept = [r["text"] for r in P.decontaminate(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == sorted([*clean, f"{clean[0]} more"])
