"""Connected components of an edge table by hooking and pointer jumping, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfeed.staging import freed, staged


def downward(edges: DataFrame) -> DataFrame:
    """Edges (a, b), longs, once each from the larger node a to the smaller b, as a table of their own."""
    return staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")


def hooked(known: DataFrame) -> DataFrame:
    """Edges of the same reachability, nearer to stars: a large-star and a small-star step.

    Each step groups by node with minima that are combined in each task; they are
    brought back by joins with exchanges of their own, so that the many edges of
    one node are no single task's work.
    """
    both = known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m")).select("k.a", F.least("k.a", "m").alias("m"))
    # large star: larger neighbours point to the smallest of the neighbourhood
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.union(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
    # small star: smaller neighbours, and the node itself, point to the smallest of them
    small_min = large.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m")).select("k.a", "m")
    small = large.join(small_min, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_min.select("a", F.col("m").alias("b"))).distinct()
    out = staged(small, "edges")
    freed(out.sparkSession)
    return out


def settled(known: DataFrame) -> bool:
    """Whether each node has one edge and no root has one."""
    nodes = known.groupBy("a").agg(F.count("*").alias("n"), F.max("b").alias("b"))
    inner = known.select(F.col("a").alias("up")).distinct()
    return nodes.join(inner, F.col("b") == F.col("up"), "left").filter("n > 1 or up is not null").isEmpty()


def labels(known: DataFrame) -> DataFrame:
    """(node, component) for every node of downward edges: the smallest neighbour, or the node itself if it has no smaller one.

    Nodes of one label are connected; of settled edges the label is the component.
    """
    own = known.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return known.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own).groupBy("node").agg(F.min("component").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b), longs; component: the smallest node reachable.

    The rounds grow with the logarithm of the longest chain.
    """
    known = downward(edges)
    while not settled(known):
        known = hooked(known)
    return labels(known)
