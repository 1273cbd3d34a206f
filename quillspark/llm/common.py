"""What the corpus operators share: Arrow mapping, word splitting, cut lineage.

A *word* is a run of characters other than space and \\x09-\\x0D. On UTF-8 bytes that is what
``bytes.split()`` gives, so words are split on bytes throughout.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import cut, shared_dir

__all__ = ["LOWER", "cut", "few", "map_batches", "record_batch", "shared_dir", "table", "text_bytes", "without"]

_UPPER = bytes(range(65, 91))
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def text_bytes(batch: pa.RecordBatch, name: str | int = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, given by its name or place; null becomes empty."""
    col = batch.column(name if isinstance(name, int) else batch.schema.get_field_index(name))
    return [b or b"" for b in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one non-empty batch to one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def few(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows, or bytes: one for every core, more only where one would get over ``each``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names clash, whatever their case, with those an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
