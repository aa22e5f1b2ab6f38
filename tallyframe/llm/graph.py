"""Connected components by alternating large-star and small-star steps.

Each step is two shuffles of (child, parent) edges; no node's neighbours are ever gathered,
and the edges of a node with very many meet its minimum by a broadcast.
Edges are written to the shared folder after each round, so lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def _large_star(e: DataFrame) -> DataFrame:
    both = written(e.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(e.select(F.col("parent").alias("u"), F.col("child").alias("v"))), "edges-both-ways")
    near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = near.select("u", F.least("u", "m").alias("m"))
    return spread_join(both.filter("v > u"), least, "u", counts=near.select("u", "n")).select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    near = e.groupBy("child").agg(F.min("parent").alias("m"), F.count("*").alias("n"))
    least = near.select("child", "m")
    moved = spread_join(e, least, "child", counts=near.select("child", "n")).filter("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return moved.unionByName(least.select("child", F.col("m").alias("parent"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of an edge, root being the least node of its component."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct()
    e = written(e, "edges")
    while True:
        # done when every child has one parent and no parent is a child
        n, children = e.agg(F.count("*"), F.count_distinct("child")).first()
        if n == children and e.select("parent").distinct().join(e.select(F.col("child").alias("parent")), "parent", "left_semi").isEmpty():
            break
        e = written(_small_star(written(_large_star(e), "edges")), "edges")
    return e.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(e.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct())
