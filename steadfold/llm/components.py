"""Connected components by alternating large-star and small-star steps; every step is joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lookup, stash


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): m is the least of u and its v's. A node may have very many of them."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup(pairs, stash(least, "star"), ["u"], "n", ["v"], total)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node that it is connected with."""
    now = stash(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        n, code = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, code) == mark:
            break
        mark = (n, code)
        # large star: every larger neighbour of u is linked to the least neighbour of u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stash(_star(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: every smaller neighbour of u, and u, are linked to the least of them
        small = _star(large, large.count())
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = stash(small.where("u != v").distinct(), "edges")
    else:
        raise RuntimeError("the components have not converged")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
