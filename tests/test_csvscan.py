"""CSV by byte ranges against the whole file read by Python's csv."""

import csv
import random

import pytest

from quillspark.sources import csvscan as C
from quillspark.sources import manifest as M

PARTS = ["a", "bc", "é", "image", ",", ",", ",", "\n", "\n", "\r\n", "\r", '"', '"', '""', '"x\ny"', '","', "\n\n", " "]


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "7", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def quoted(rnd, n, width):
    cell = lambda: "".join(rnd.choice(["a", "é", '""', "\n", "\r\n", ",", "long word ", " "]) for _ in range(rnd.randint(0, 9)))
    return "\n".join(",".join(f'"{cell()}"' if rnd.random() < 0.6 else rnd.choice(["x", "", "y z", "p\"q"]) for _ in range(width)) for _ in range(n)) + rnd.choice(["", "\n", "\n\n"])


def test_states_of_lines():
    """Composed states of single lines against the reader's own."""
    rnd = random.Random(1)
    for _ in range(20_000):
        line = "".join(rnd.choice(["a", ",", '"', '""', "\r", " "]) for _ in range(rnd.randint(0, 9)))
        try:
            rows = list(csv.reader([line + "\n", 'z"z'], strict=False))
        except csv.Error:
            continue
        # what follows is taken in only if quotes are open
        assert C._opens(line) == ("\n" in rows[-1][-1]), line


@pytest.mark.parametrize("ranges", [C.RANGES, 0])
def test_random_files(spark, tmp_path, small_ranges, ranges):
    rnd = random.Random(7)
    texts = {}
    for k in range(60):
        kind = k % 3
        text = quoted(rnd, rnd.randint(1, 12), 3) if kind else "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 40)))
        texts[f"f{k}.csv"] = ("Image,b,c\n" if kind == 2 else "") + text
    texts |= {"long.csv": 'a,"' + "no end of it\n" * 30 + '",c\nd,e,f\n', "open.csv": 'a,b\n"c,d\n', "head.csv": 'image,"x\n\n\ny"\n1,2\n', "only.csv": "image,b\n", "blank.csv": "\n\r\n\n"}
    for name, text in texts.items():
        with open(tmp_path / name, "w", newline="") as f:
            f.write(text)
    got = {}
    for r in C.scan_csv(spark, f"{tmp_path}/*.csv", "image", ranges).collect():
        got.setdefault(r["file"].rpartition("/")[2], []).append((r["row_idx"], r["fields"], r["error"]))
    for name, text in texts.items():
        want = expected(text)
        assert sorted(got.get(name, []), key=repr) == sorted(want, key=repr), (name, text)


def expected(text):
    try:
        rows = C.parsed(text)
    except csv.Error as e:
        return [(None, None, str(e))]
    if not rows:
        return [(None, None, "the manifest is empty")]
    if len({len(r) for r in rows}) > 1:
        return [(None, None, "wrong number of fields")]
    return [(i, r, None) for i, r in enumerate(rows[rows[0][0].strip().lower() == "image" :])]


def test_a_large_file_is_many_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        with open(tmp_path / "m.csv", "w", newline="") as f:
            f.write("image,transcript,public\n")
            for k in range(60_000):
                f.write(f'"i{k}\n.jpg","say ""{k}"", twice",1\n')
        assert C._lines(spark, str(tmp_path / "m.csv")).rdd.getNumPartitions() >= 8
        rows = M.read_manifest(spark, str(tmp_path / "m.csv"))
        assert rows.count() == 60_000
        assert rows.where("fields[0] = concat('i', row_idx, '\n.jpg') and fields[1] = concat('say \"', row_idx, '\", twice')").count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
