"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two groupings over the edges; the edges never leave the executors and
every round is cut with a written table, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (only larger ones if ``large``, else smaller ones) to its minimum."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    if not large:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = both.where("v > u") if large else both
    out = near.join(low, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    if not large:
        out = out.union(low.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b: any comparable type).

    Nodes without an edge are absent: each is its own component. Nodes with one are all present, roots too. Self edges and repeated edges
    are harmless, null ends are ignored, and an empty table gives an empty result.
    """
    ordered = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = cut(edges.where("a is not null and b is not null and a <> b").select(*ordered).distinct())
    seen = None
    while True:
        now = cut(_star(_star(now, large=True), large=False).select("a", "b"))
        # xor and count tell two edge sets apart; equal sets mean that every edge joins a node to its root
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
