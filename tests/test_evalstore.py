"""Result stores as a data source: pushed filters, stores replaced all or none."""

import json
import os
import random

import pytest
import yaml
from pyspark.sql import functions as F

from quillspark.sources import evalstore as E
from quillspark.sources import store as S


def made(folder, n, **more):
    os.makedirs(folder, exist_ok=True)
    for k in range(n):
        config = {"provider": "p", "model": f"m{k % 3}", "timeout": "2m0s", "ignorepatterns": ["|"], "maxresolution": "HIGH", "maxresolutionfallback": True} | more
        results = [{"identifier": f"{k}-{i}", "providerresponse": f"é: {i}\n- 'x'", "charactersimilarity": 0.5, "inputtokens": i} for i in range(3)]
        with open(f"{folder}/s{k:03}.yaml", "w") as f:
            yaml.safe_dump({"config": config, "results": results}, f, allow_unicode=True, sort_keys=False)


def opened(df):
    """Names of the files that the scan's partitions hold."""
    return {r[0] for r in df.select("file").distinct().collect()}


def test_reads_what_the_text_reader_reads(spark, tmp_path):
    at = str(tmp_path / "evals")
    made(at, 5)
    (tmp_path / "evals/bad.yaml").write_text("config: [")
    (tmp_path / "evals/empty.yaml").write_text("config: {model: e}\nresults: []\n")
    (tmp_path / "evals/other.txt").write_text("no store")
    rows = E.scan(spark, at)
    old = S.flat_results(S.read_stores(spark, f"{at}/*.yaml"))
    assert sorted(map(repr, rows.where("error is null").select(old.columns).collect())) == sorted(map(repr, old.collect()))
    assert [r["file"] for r in rows.where("error is not null").collect()] == ["bad.yaml"]
    assert [r["pos"] for r in rows.where("file = 's001.yaml'").orderBy("pos").collect()] == [0, 1, 2]
    assert E.scan(spark, f"{at}/s001.yaml").count() == 3 and E.scan(spark, f"{at}/s00*.yaml").where("error is null").count() == 15
    assert spark.read.format("evalstore").option("files", 2).load(at).rdd.getNumPartitions() == 4
    assert E.scan(spark, str(tmp_path / "nothing")).count() == 0


def test_pushed_filters_open_fewer_files(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "evals")
    made(at, 9)
    for name in ("s004.yaml", "s007.yaml"):  # opening these for a filter on other names would give a row with error
        (tmp_path / "evals" / name).write_text("config: [")
    E.register(spark)
    read = lambda: spark.read.format("evalstore").option("files", 1).load(at)
    for wanted, n in ((F.col("file") == "s001.yaml", 1), (F.col("file").isin("s001.yaml", "s002.yaml", "none.yaml"), 2), (F.col("file").startswith("s00"), 9), (F.col("file").startswith("s005"), 1)):
        df = read().where(wanted)
        assert df.rdd.getNumPartitions() == n
    assert opened(read().where("model = 'm1'")) == {"s001.yaml"}
    assert read().where("model in ('m0', 'm2')").count() == 18
    parsed = []
    reader = E._Reader(at, 64)
    monkeypatch.setattr(E, "parsed_store", lambda text: parsed.append(text) or S.parsed_store(text))
    list(reader.pushFilters([E.EqualTo(("model",), "m2")]))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len([r for r in rows if r[-1] is None]) == 9 and len(parsed) == 3 + 2  # three stores of the model, two broken ones


def test_stores_are_replaced_in_one_job(spark, tmp_path):
    at = str(tmp_path / "evals")
    made(at, 1000)
    rows = E.scan(spark, at)
    changed = rows.where("file < 's998.yaml'").withColumn("char_similarity", F.lit(0.75)).repartition(7)
    changed = changed.withColumn("further", F.lit("column"))
    E.write_stores(changed, at)
    after = E.scan(spark, at)
    assert after.count() == 3000 and after.where("char_similarity = 0.75").count() == 998 * 3
    assert sorted(map(repr, after.drop("char_similarity").collect())) == sorted(map(repr, rows.drop("char_similarity").collect()))
    assert [f for f in os.listdir(at) if f.startswith(".") and not f.endswith(".crc")] == []
    one = yaml.safe_load(open(f"{at}/s005.yaml"))
    assert one["config"]["maxresolution"] == "HIGH" and one["config"]["timeout"] == "2m0s" and [r["identifier"] for r in one["results"]] == ["5-0", "5-1", "5-2"]


def test_a_failing_task_leaves_every_store(spark, tmp_path):
    at = str(tmp_path / "evals")
    made(at, 12)
    before = {f: open(f"{at}/{f}").read() for f in os.listdir(at)}
    boom = F.udf(lambda f: 1 / 0 if f == "s007.yaml" else f, "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        E.write_stores(E.scan(spark, at).withColumn("response", boom("file")), at)
    assert {f: open(f"{at}/{f}").read() for f in os.listdir(at)} == before
    rows = E.scan(spark, at)
    for name in ("../out.yaml", "none", ".hidden.yaml"):
        with pytest.raises(Exception, match="not the name of a store"):
            E.write_stores(rows.withColumn("file", F.lit(name)), at)
    assert {f: open(f"{at}/{f}").read() for f in os.listdir(at)} == before


def test_a_lost_driver_s_moves_are_carried_out(spark, tmp_path):
    at = str(tmp_path / "evals")
    made(at, 3)
    os.makedirs(f"{at}/.aside-1")
    for k in (0, 2):  # the first of three moves was made before the driver was lost
        with open(f"{at}/.aside-1/a{k}", "w") as f:
            f.write(f"config:\n  model: new\nresults:\n- identifier: new{k}\n")
    with open(f"{at}/.moving-1", "w") as f:
        json.dump({"aside": ".aside-1", "moves": [["gone", "s001.yaml"], ["a0", "s000.yaml"], ["a2", "added.yaml"]]}, f)
    with open(f"{at}/.moving-2.part", "w") as f:  # not yet decided: nothing is moved
        f.write("{")
    got = {(r["file"], r["identifier"]) for r in E.scan(spark, at).collect()}
    assert got == {("s000.yaml", "new0"), ("added.yaml", "new2"), *{(f"s00{k}.yaml", f"{k}-{i}") for k in (1, 2) for i in range(3)}}
    assert not os.path.exists(f"{at}/.moving-1") and not os.path.exists(f"{at}/.aside-1")


def test_every_text_comes_back(tmp_path):
    """Line breaks of all kinds, between spaces and blank lines: PyYAML's own writer loses or adds some."""
    rnd, alphabet = random.Random(5), [*" \n\t\r\"'#:-|>&*!%@`{}[],?a0\\~\u00e9\u0085\u00a0\u2028\u2029\ufeff\U0001f600\x7f", "\n\n", "word " * 30]
    for k in range(400):
        text = " b{\u0085{" if not k else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        row = {c: kind() for _, c, kind in S.RESULT_KEYS} | {"response": text, "identifier": text[:5], "char_similarity": rnd.choice([0.1, 1e-7, 1e22, -0.0, float("inf"), None]), "input_tokens": k}
        made = S.result_yaml(row)
        assert made == S.dumped([{key: row[c] for key, c, _ in S.RESULT_KEYS}])
        for load in (yaml.safe_load, S.loaded):
            assert load(made)[0] == {key: row[c] for key, c, _ in S.RESULT_KEYS}


def test_listing_takes_few_tasks(spark, tmp_path):
    for k in range(700):
        (tmp_path / f"s{k:03}.yaml").write_text("config: {}\n")
    listed = S.list_stores(spark, str(tmp_path))
    assert [r["file"] for r in listed.collect()] == [f"s{k:03}.yaml" for k in range(700)]
    assert "Coalesce 16" in listed._jdf.queryExecution().executedPlan().toString()
