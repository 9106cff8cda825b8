"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspark.functions.durable import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("w"))
    pair = F.array(F.struct("u", F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))
    return down.join(least, "u").select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (long columns u, v); root is the smallest node reachable.

    Each round is written to the shared folder. Rounds end when no link changes, after some
    log2 of the longest path.
    """
    stars = durable(edges.where("u <> v").select("u", "v").distinct(), "links")

    def state(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = state(stars)
    while seen[0]:
        stars = durable(_small_star(_large_star(stars)), "stars")
        now = state(stars)
        if now == seen:
            break
        seen = now
    ends = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ends)
