"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage gets all documents its predecessor kept and returns the columns of ``documents``, the last one the pieces.
Ids may be null or repeated, texts null, empty or of any length, further columns are carried along; an empty table gives
an empty table at every stage. Each stage's docstring says what it makes of such rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import shared_dir
from quillspark.llm.decontaminate import uncontaminated
from quillspark.llm.lines import dedup_lines
from quillspark.llm.packing import pack
from quillspark.llm.queries import packing_tokenizer
from quillspark.llm.repetition import quality
from quillspark.llm.simhash import one_of_each


#: Bytes of a table that are handed to Python at a time; Spark's own setting is eight times as much.
BATCH = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(spark: SparkSession) -> None:
    """Whole texts go to Python: let a task hold few of them at a time, on either side."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SETTING)) > BATCH:
        spark.conf.set(_SETTING, BATCH)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; repeated rows are judged alike."""
    _bounded(spark)
    return quality(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs go; a document of which nothing but white space is left goes too. n_chars follows the text."""
    left = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups by five-word shingles of similarity 0.8; of each one row with the smallest doc_id stays, a null one if all are.

    Rows are known by doc_id and text, as in line dedup: unlike texts under one id, or under none, all stay.
    """
    _bounded(spark)
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go, each row judged by itself. Items of under eight words prove nothing and count for nothing."""
    _bounded(spark)
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, repeated ones too; ids may be null or repeated. No rows: no pieces."""
    _bounded(spark)
    return pack(docs, packing_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: The stages' automata, tokenizer and local search aren't SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's table goes as soon as the next one is written; the last one stays, to be read. If a stage fails, none stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    gone = lambda path: (p := spark._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                gone(f"{folder}/{k - 1}")
    except Exception:
        gone(folder)
        raise
    return docs
