"""Small tables for the corpus operators' tests, with every odd case: nulls, blanks, long texts, repeats, clashing columns."""

from __future__ import annotations

import random
from contextlib import contextmanager

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rnd: random.Random, n: int, of: int = 300) -> str:
    return " ".join(f"w{int(of * rnd.random() ** 2)}" for _ in range(n))


def texts(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    passage = words(rnd, 60)
    made = [words(rnd, rnd.randint(1, 120)) for _ in range(40)]
    made += [f"{words(rnd, 20)}\n{passage}\n{words(rnd, 15)}" for _ in range(3)]
    made += [made[3], made[3], made[5], made[5].replace("w1", "w2", 1), "", " \t\n ", "one", "one two", "the the the the the the the the the the the"]
    made += ["\n".join([words(rnd, 12)] * 9), words(rnd, 9000), "é ü Ä ß 你好 😀 naïve  nbsp\x1cmark", "|" * 50 + " a\n" * 30]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(made)]
    return [*rows, (None, made[0], None, None, None), (None, None, None, None, None), (900, None, "en", "s", None), rows[1], rows[1]]


def frame(spark, rows=None, clash: tuple[str, ...] = ()):
    """``clash``: names of string columns that the operator itself adds."""
    rows = texts() if rows is None else rows
    schema = SCHEMA + "".join(f", `{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *(["x"] * len(clash))) for r in rows], schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@contextmanager
def many_partitions(spark, name: str):
    """Shuffles of 64 partitions that aren't coalesced meanwhile; the list given gets, at the end, each run stage's number of tasks."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, stages = {k: spark.conf.get(k) for k in settings}, []
    for k, v in settings.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(name, name)
    try:
        yield stages
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    said = spark.sparkContext.statusTracker()
    ran = {s: said.getStageInfo(s) for job in said.getJobIdsForGroup(name) for s in said.getJobInfo(job).stageIds}
    stages += [s.numTasks for s in ran.values() if s and s.numCompletedTasks]
