"""Connected components of a graph of links, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (a, b): component is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each node's neighbours are linked to
    the smallest of them, until every component is a star: no node that others are linked to has itself a
    smaller one.  The rounds grow with the logarithm of the longest path.  A hub's smallest neighbour is an
    aggregate; its links meet it in a join on the hub, 16 bytes each and in one task where that join isn't broadcast.
    As links lead from the larger end to the smaller one, a round gives no more links than it got.
    Null ends are no nodes.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("root").alias("root"))  # edges are distinct: a leaf of stars has one
        if ends.where("links > 1 OR links = 1 AND root = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = edges.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(near.distinct(), "edges")
        forget(before)
    raise RuntimeError(f"no stable components after {most_rounds} rounds")
