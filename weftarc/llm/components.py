"""Connected components of an edge table by alternating stars, every round an aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftarc.llm.scratch import stored

MAX_ROUNDS = 60


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least-large")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least-small")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of longs without nulls to (a, b): every node that is not the least of its component, and that least node.

    The rounds needed grow with the logarithm of a component's size. The minima are written before they are
    joined, so that Spark can split the edges of a node with very many of them. Loops and repeated edges do no
    harm; no edges give no rows.
    """
    edges = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    size = _size(edges)
    if not size[0]:
        return edges
    for _ in range(MAX_ROUNDS):
        edges = stored(_small_star(stored(_large_star(edges), "large-star")), "small-star")
        new = _size(edges)
        if new == size:
            return edges
        size = new
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
