"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    """What tells one set of distinct edges from another."""
    mark = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mark), F.sum(mark.bitwiseAND(F.lit((1 << 31) - 1)))).first())


def connected(edges: DataFrame, docs: int | None = None) -> DataFrame:
    """node and root, the smallest node of its component, of every node of ``edges(a, b)``
    but the roots themselves.  Rounds grow with the logarithm of a component's size;
    minima are combined before each shuffle, and no node's edges meet in one row.
    ``docs``: see ``written``."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", docs)
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: what is above a node goes to the node's least neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and what is below it go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(down.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges", docs)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
