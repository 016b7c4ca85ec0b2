"""Connected components by alternating large-star and small-star joins.

Neighbours are never gathered: a round takes each vertex's least neighbour by a
pre-aggregated minimum and joins it back to the edges. The joins are plain
equi-joins, so a hub that holds a large part of all edges is split by adaptive
execution (its least neighbour is one row, which each part reads).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldenloom.session import Scratch


def digest() -> tuple:
    """Aggregates that tell two sets of edges (u, v) apart."""
    return F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mix"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("sum")


def star_round(stars: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v)."""
    both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def star_forest(edges: DataFrame, scratch: Scratch, label: str = "stars") -> DataFrame:
    """(u, v) with the least vertex v of its component for every other vertex u of edges (u, v)."""
    before, step, stars = None, 0, edges
    while True:
        stars, now = scratch.save_and(star_round(stars), f"{label}-{step}", *digest())
        if step:
            scratch.drop(f"{label}-{step - 1}")
        step += 1
        if now == before:
            return stars
        before = now


def components(pairs: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in ``pairs`` (a, b)."""
    scratch = Scratch(pairs.sparkSession, "components")
    edges = scratch.save(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stars = star_forest(edges, scratch)
    heads = stars.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads)
