"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: every vertex ties its neighbours to its least one."""
    if small:
        near = edges
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """Vertices on some edge, with the least vertex of their component: columns node, component.

    Self-edges are ignored. Each round is written to the shared folder, so lost executors cost
    one round at most. The number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = stored(edges, label), None
    check = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    sign = now.agg(F.count("*"), check).first()
    while True:
        then = stored(star(star(now, False), True), label)
        new = then.agg(F.count("*"), check).first()
        dropped(now)
        now, before, sign = then, sign, new
        if before == sign:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
