"""Connected components by alternating large and small stars, on edges of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours join the least of its neighbourhood: those above it (large star), or those
    not above it (small star). Minima are pre-aggregated and the join's hot side can be split."""
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if small else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("m"))
    out = both.join(least, "u")
    if small:
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(out.where("v <= u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is its component's least node."""
    now = materialize(edges.where("u <> v").distinct(), "edges")
    mark = None
    while True:
        after = materialize(_star(_star(now, small=False), small=True), "edges")
        got = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
