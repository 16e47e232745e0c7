"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (``u``, ``v``, both long) to (``v``, ``root``): for every vertex of an edge other than
    a root, the smallest vertex of its component. Each step is grouped and joined by vertex; its
    result is checkpointed, so lost executors cost no more than one step. Steps repeat until the
    edges no longer change (about the logarithm of the longest path)."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = now.checkpoint()
    before = _state(now)
    while before[0]:
        # large-star: neighbours above a vertex move to the smallest vertex around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")).checkpoint()
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v").checkpoint()
        # small-star: a vertex and its smaller neighbours move to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = (large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = small.checkpoint()
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])
