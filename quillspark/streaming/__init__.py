"""Scoring as a stream: pairs or manifests that keep arriving.

``score`` is a projection without state, so it runs unchanged on a streaming DataFrame. The running leaderboard keeps one
row of sums for each store, or with a watermark one for each store and window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.report import MEANS
from ..operators.score import score


def score_stream(pairs: DataFrame, **options) -> DataFrame:
    """``pairs`` may be a stream of (ref, hyp, ...)."""
    return score(pairs, **options)


def running_leaderboard(scored: DataFrame, by: list[str], time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means by store, in windows of ``time`` if it is given; rows later than ``late`` are left out then."""
    keys = [F.col(c) for c in by]
    if time:
        scored = scored.withWatermark(time, late)
        keys.append(F.window(time, window).alias("window"))
    return scored.groupBy(*keys).agg(F.count("*").alias("total_evaluations"), *[F.avg(f"m.{c}").alias(n) for n, c in MEANS.items()])


def to_store(scored: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append scored rows to a Parquet store, exactly once."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
