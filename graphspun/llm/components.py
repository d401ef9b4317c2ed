"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per vertex (combined before the shuffle, so a centre with millions of
neighbours is no burden), one equi-join back to the edges, which adaptive execution may split, and a
distinct. No vertex's neighbours are ever listed. The number of rounds grows with the logarithm of
the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import written


def _linked_to_least(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b). Large star: every larger neighbour of a vertex is linked to the least of its neighbours and itself.
    Small star: every vertex's smaller neighbours, and itself, are linked to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component): each vertex of an edge with the least vertex it can reach. Self-links are ignored."""
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = written(_linked_to_least(_linked_to_least(now, True), False), "links")
    tops = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return tops.unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
