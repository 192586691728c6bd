"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and joins on the edges alone and ends in a written table in the
shared folder. Edges with a null end, loops and repeats are dropped; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's greater neighbours move to its least neighbour. Small: each node and its smaller neighbours do."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), F.col("u"))
    out = moved.where(F.col("a") > F.col("u")).select("a", "b") if large else moved.select("a", "b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every node of the edges, root being the smallest id of its component."""
    now = common.cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for _ in range(MOST_ROUNDS):
        now = common.cut(_star(_star(now, True), False), "stars")
        # done when no node has two edges and no root has an edge to a smaller one
        ends = now.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("id"), F.when(F.col("n") > 1, 1).otherwise(0).alias("many"), F.lit(1).alias("leaf"), F.lit(0).alias("root"))
        ends = ends.unionByName(now.select(F.col("b").alias("id")).distinct().select("id", F.lit(0).alias("many"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        if ends.groupBy("id").agg(F.max("many").alias("many"), F.max("leaf").alias("leaf"), F.max("root").alias("root")).where("many = 1 or (leaf = 1 and root = 1)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
