"""Connected components of an edge table by alternating stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(edges: DataFrame, bound: bool) -> DataFrame:
    """(a, least): the least neighbour of each node, itself included if ``bound``."""
    least = F.min("b")
    return edges.groupBy("a").agg((F.least(least, F.col("a")) if bound else least).alias("least"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node that it reaches.

    A round links each node's larger neighbours to its least neighbour, then the smaller ones, until nothing changes:
    about log of the longest path rounds. Least neighbours are combined before the shuffle, and the joins that hand
    them out are plain equality joins whose hot partitions Spark can split, so a node with very many links is no
    single task's work. Each round is written to the shared folder; the driver sees a count and a sum of hashes.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    while True:
        # Large star: larger neighbours meet the least of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both, True), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large-star")
        # Small star: a node and its smaller neighbours meet the least of them.
        least = _least(large, False)
        small = large.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    # All edges now lead to roots.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
