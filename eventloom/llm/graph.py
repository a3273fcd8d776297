"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return skew_join(around.filter(F.col("b") > F.col("a")), least, ["a"], "degree", total=2 * links).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them.

    After a large star no node has many smaller neighbours that are tied to it.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node reachable.

    Alternates the two star steps until nothing changes; every round is a
    table in the shared folder, and a star's centre with very many links is
    joined apart from the others. Loops (a = b) and repeated edges do no harm;
    nodes without an edge to another node aren't returned.
    """
    now = staged(edges.select("a", "b").filter("a <> b").distinct(), "links")
    mark, links = None, now.count()
    for _ in range(max_rounds):
        now = staged(_small_star(_large_star(now, links)), "stars")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark, links = seen, seen["n"]
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
