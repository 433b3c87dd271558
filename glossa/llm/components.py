"""Connected components of an edge table by alternating large and small stars.

Every step is a combining aggregate and a join; an edge list never leaves the
executors.  Each round is written to the shared folder and the one before
is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch


def _stars(e: DataFrame) -> bool:
    """Every node has one link downwards, and no link leads to a node that has one: the links are stars."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges`` (u, v), any order, repeats and loops allowed -> (id, component)
    for every node with an edge to another; component is the smallest id."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, k = scratch.keep(e, f"{name}0"), 0
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low2.withColumnRenamed("m", "v")).distinct())
        k += 1
        e = scratch.keep(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
