"""Connected components of links that are themselves a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (u, v) has one edge, but for the lower ends: one that is lower has no edge down."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.count("*").alias("n"))
    return nodes.where("ups > 1 OR (ups = 1 AND n > 1)").count() == 0


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) to (node, component): the least node that each linked node reaches. Nodes without links have no row.

    Alternating large and small stars: every node hands its larger, then its smaller neighbours to the least of them, until each component is a star, in rounds
    of about the logarithm of the longest chain; links that are stars already take none. Each round is written out; one figure a round comes to the driver.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if _stars(edges):
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
    else:
        if not _stars(edges):
            raise RuntimeError(f"components are no stars after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
