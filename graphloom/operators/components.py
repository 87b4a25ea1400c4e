"""Connected components of an undirected edge table, as DataFrame joins with written intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import removed, scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v), u > v, either has one smaller neighbour or is one: v is then
    the smallest node that u reaches.  One aggregation by node, combined before its shuffle."""
    end = lambda c: F.struct(F.col(c).alias("node"), F.lit(int(c == "u")).alias("above"), F.lit(int(c == "v")).alias("is_above"))
    ends = edges.select(F.explode(F.array(end("u"), end("v"))).alias("e")).select("e.*")
    by_node = ends.groupBy("node").agg((F.sum("above") + F.max("is_above")).alias("parts"))
    return (by_node.agg(F.max("parts")).first()[0] or 0) < 2


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected components in MapReduce and
    beyond"): O(log^2 n) rounds.  A round joins every edge with the smallest neighbour of its end; that
    minimum is combined before the shuffle, so a node with very many neighbours costs its task one row per
    map task, and the join against it is a sort-merge join that adaptive execution can split.  Each round's
    edges are written to the shared folder, and rounds end once they are stars (``_stars``), without a round that only
    finds nothing to change.  Nodes without an edge are not returned; a null end drops the edge.
    """
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(path)
    for _ in range(max_rounds):
        now = spark.read.parquet(path)
        if _stars(now):
            break
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour (or itself)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller-or-equal neighbour is tied to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = scratch(spark, "edges")
        small.write.parquet(nxt)
        removed(spark, path)
        path = nxt
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = spark.read.parquet(path)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v")).distinct()
