"""The folder that driver and executors share, and lineage cut there."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine, which only a local master may use."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), f"quillspark-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def file_system(path: str):
    """pyarrow's file system of a path or URI, and the path in it: for what Python code opens itself."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: lineage ends, lost executors lose nothing.

    The files go when Spark's cleaner removes checkpoints (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
