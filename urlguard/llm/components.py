"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlguard.llm.common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds to each edge (u, v) the smallest of u and its neighbours, without gathering them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select(F.col("u").alias("w"), F.least("u", "least").alias("least"))
    return edges.join(least, F.col("u") == F.col("w")).drop("w")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    moved = met.select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = met.select("u", F.col("least").alias("v"))
    return moved.unionAll(own).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v), except roots, whose component is themselves.

    ``component`` is the smallest node reachable. Every round is written to the work folder; the
    number of rounds grows with the logarithm of the number of nodes.
    """
    clean = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(clean.distinct(), "edges")
    before = _mark(now)
    while before[0]:
        now = stored(small_star(large_star(now)), "edges")
        after = _mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
