"""Connected components of an edge table, by alternating large and small stars.

Joins on a node deal the edges of nodes with very many of them by broadcast, so a
large component's smallest node doesn't end up in one task. Both steps keep components as they are; the edge table turns into one star for each
component around its smallest node. Every round ends in a table in the shared
folder, so no lineage builds up and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stored


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"), F.count_if(F.col("other") > F.col("node")).alias("n")).where("n > 0")
    moved = join_hot(both.where("other > node"), least.select("node", F.least("node", "least").alias("least"), "n"), "node", "n", rows)
    return moved.select(F.col("other").alias("high"), F.col("least").alias("low"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n"))
    moved = join_hot(edges, least.where("n > 1"), "high", "n", rows).where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (two long columns), component being the smallest node reachable."""
    a, b = edges.columns
    now = stored(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        size = mark[0] if mark else now.count()
        large = stored(_large_star(now, size).where("high <> low").distinct(), "large-stars")
        now = stored(_small_star(large, size).where("high <> low").distinct(), "stars")
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(now.select("low", "low").distinct())
