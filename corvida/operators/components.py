"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's neighbours (those larger than it, or those not larger) are tied to the least node seen.
    Edges lead from the larger node to the smaller, before and after."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    # a table of its own: Spark can then split the join where one node has very many edges
    least = stored(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
    tied = both.join(least, "u")
    if large:  # a row for each edge, so repetitions may stay until the next step
        return tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    tied = tied.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node and none to it, or none to a smaller one."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not nodes.groupBy("node").agg((F.sum("tied") + F.max("centre")).alias("roles")).where("roles > 1").limit(1).count()


def roots(parents: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, component) of a forest in which every node but the roots has one parent smaller
    than itself: each round takes the parent's parent, so paths halve. Roots are in the result."""
    now = stored(parents.select(F.col(node).alias("node"), F.col(parent).alias("parent")), "parents")
    while True:
        above = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        after = stored(now.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        if not after.where("moved").limit(1).count():
            break
        now = after.drop("moved")
    return after.select("node", F.col("parent").alias("component")).union(after.select("parent", "parent").distinct())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Alternates the large-star and small-star steps until the edges are stars, which takes about
    log(n) rounds and keeps the number of edges within that of the input; edges that are stars
    already take none. Null ends are dropped.
    """
    now = edges.select(F.greatest(left, right).cast("long").alias("a"), F.least(left, right).cast("long").alias("b"))
    now = stored(now.where("a <> b").distinct(), "edges")
    while not _stars(now):
        now = stored(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
