"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _least_neighbour(e: DataFrame) -> DataFrame:
    """For each a: the least of a and all its b."""
    return e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least_neighbour(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least_neighbour(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of links (a, b) of longs; nodes without links are absent.

    Joins and aggregates only, so a hub with very many links is split by skew-join handling and map-side
    combining. Self-links and repeats are allowed. An empty table gives an empty table.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        edges = saved(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)).alias("x")).first()
        if seen == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
