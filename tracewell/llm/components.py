"""Connected components by alternating large and small stars, over tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points a node's neighbours (the larger ones, or the smaller ones and itself) at its least neighbour."""
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = salted_join(ends, least, ["u"], 8)
    if large:
        met = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        met = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return met.filter("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node but the roots; root is the least node that links lead to.

    links has two bigint columns; loops, repeats and nulls don't matter. No links give no rows. Each round
    is written to the shared folder; their number grows with the logarithm of the longest chain.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, seen = stored(edges), None
    while True:
        edges = stored(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
