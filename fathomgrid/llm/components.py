"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; ``edges(u, v)`` once each, u < v."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.union(back) if large else back  # u with its neighbours, or with its smaller ones
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    seen = near.join(least, near["u"] == least["c"])
    if large:
        out = seen.filter(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v")
    else:
        out = seen.select(F.col("m").alias("u"), "v").union(least.select(F.col("m").alias("u"), F.col("c").alias("v")))
    return out.filter("u < v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node but the roots; root is the smallest node of a component.

    ``edges(u, v)`` are longs without nulls; loops, repeats and either direction are
    fine. Every round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain.
    """
    edges = materialise(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = mark
        if mark[0]:
            edges = materialise(_star(materialise(_star(edges, True)), False))
