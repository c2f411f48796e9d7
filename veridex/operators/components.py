"""Connected components of an edge table by alternating large and small stars.

Each round links every node's larger neighbours, then its smaller ones, to the least node it sees, until every node has
one edge at most and leads to a node without one: a graph of stars. Rounds grow with the logarithm of the longest path. Minima are combined before the shuffle,
edges of frequent nodes are joined, not collected, and each round is a staged table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # staged, so that the join has plain exchanges on both sides: the hub of a huge component is a hot key, and is split
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
    joined = down.join(least, F.col("u") == F.col("x"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (u, v); the component is its least node."""
    now = edges.select("u", "v").filter("u <> v")
    for _ in range(rounds):
        now = stage(_small(_large(now)).distinct(), "edges")
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down + up > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # every edge now leads from a node to its component's least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
