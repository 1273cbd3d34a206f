"""Registered queries whose work has to be dealt to more tasks as their tables grow."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog


def test_pictures_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "PICTURES", 1000)
    spark.range(9000).selectExpr("nullif(id, 5) as p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = catalog.components(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 9
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet' WHERE p_partkey IS NOT NULL")
    want = db.sql(entry.oracle_sql()["components"])
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in want.columns) for r in found.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["merge_boxes", "line_runs", "box_envelope", "line_fold", "hocr_pages", "hocr_tree", "basic_hocr", "line_words"])
def test_pages_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch, name):
    monkeypatch.setattr(catalog, "BOXES", 500)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    found = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= rows / 500 > 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan  # everything after the dealing stays where it is
