"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = _both(edges)
    return both.join(_least(both), F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    tied = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the least node of the component and has no row of its own.

    Each turn writes the edges once; a node's edges are aggregated before they are joined, never listed in one place."""
    edges, seen = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges"), None
    for _ in range(most):  # large-star and small-star turns grow with the logarithm of the longest chain
        new = materialize(small_star(large_star(edges)), "edges")
        discard(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} turns")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
