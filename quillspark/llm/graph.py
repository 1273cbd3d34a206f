"""Connected components by alternating large-star and small-star rounds, each cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, few


#: Links that a task has: it is their number that makes tasks, not the session's partitions, of which each would have a few.
LINKS = 50_000


def _stars(links: DataFrame, tasks: int) -> DataFrame:
    """(u, v, m): each link with the smallest of u and u's neighbours. The minimum is combined before the shuffle."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    # merged: a broadcast would read every partition of the shuffle by a task of its own
    return links.hint("merge").join(least, "u").withColumn("m", F.least("u", "m")).coalesce(tasks)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge; label is the component's smallest node.

    Rows grow with the links, never with pairs of a group, and tasks and files of a round with the links too. Null ends are ignored. No edges: no rows.
    """
    state = lambda links: links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    links = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    now, before = state(links), None
    tasks = few(links.sparkSession, now[0], LINKS)  # rounds make no links
    while now != before:
        links = links.coalesce(tasks)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = _stars(both, tasks).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        stars = _stars(links, tasks)
        links = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(links.union(stars.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        now, before = state(links), now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select(F.col("v"), F.col("v")).distinct().coalesce(tasks))
