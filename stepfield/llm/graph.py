"""Connected components of an edge table by alternating star contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of u, and u, is linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (a, b): every node but the least of its component, with the least.

    Rows never exceed the edges' number by more than a node each; a hub's rows are joined, not gathered, so adaptive
    execution can split them. Self-loops and repeated edges are harmless. Raises if `rounds` don't settle it."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = written(edges, "components"), None
    for _ in range(rounds):
        sign = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign.n == 0 or (sign.n, sign.s) == last:
            return edges
        last = (sign.n, sign.s)
        edges = written(_small_star(_large_star(edges)), "components")
    raise RuntimeError(f"components not settled after {rounds} rounds")
