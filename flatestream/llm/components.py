"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: each larger neighbour of u goes to the least node around u. Small: each smaller one, and u itself.

    Least nodes are pre-aggregated and joined from a table, so that a node with very many neighbours is split by Spark.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star-least")
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    out = materialize(moved.where("u <> v").distinct(), "star-edges")
    forget(least)
    return out


def connected(links: DataFrame) -> DataFrame:
    """node, component: for every node of links (a, b), the least node that it reaches. No row for nodes without links."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star-edges")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        wide = _star(edges, large=True)
        forget(edges)
        edges = _star(wide, large=False)
        forget(wide)
