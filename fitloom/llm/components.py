"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and minimum aggregates: no neighbour list is gathered, so a node with
a third of all edges is one partial aggregate and one side of a join that adaptive execution
splits. Each round's edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): the smallest node reachable; nodes without an edge are absent.

    Nodes may be of any type with an order. Loops and repeated edges do no harm.
    """
    edges = scratch(edges.select("a", "b").where(F.col("a") != F.col("b")), "cc-edges")
    seen = None
    while True:
        edges = scratch(_small_star(_large_star(edges)), "cc-round")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
