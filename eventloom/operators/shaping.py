"""Shaping candidates into a result window of sessions and roots.

Candidates are a bounded pool (4,096 at most), so the windows here are small;
they partition by session and by root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import final_order

PRIMARY_TOLERANCE = 0.95


def session_champions(candidates: DataFrame) -> DataFrame:
    """Best candidate of each session, with ``more_matches``: the others in the pool."""
    w = Window.partitionBy("session_id")
    return (
        candidates.withColumn("__rank", F.row_number().over(w.orderBy(*final_order())))
        .withColumn("more_matches", F.count(F.lit(1)).over(w) - 1)
        .filter("__rank = 1")
        .drop("__rank")
    )


def diversified(champions: DataFrame) -> DataFrame:
    """Sessions in shown order (``shown`` from 1): a champion of every root first, in
    order of the root's strongest score, then round after round of the others.

    A root's champion is its strongest session, or the first primary session
    within 95 % of that.
    """
    by_root = Window.partitionBy("root_id")
    order = [*final_order(), F.col("session_id").asc()]
    ranked = (
        champions.withColumn("root_id", F.coalesce("root_session_id", "session_id"))
        .withColumn("strongest", F.max("score").over(by_root))
        .withColumn("place", F.row_number().over(by_root.orderBy(*order)))
    )
    fit = (F.col("agent_scope") == "primary") & (F.col("score") >= F.col("strongest") * PRIMARY_TOLERANCE)
    chosen = ranked.withColumn("champion", F.coalesce(F.min(F.when(fit, F.col("place"))).over(by_root), F.lit(1)))
    rounds = chosen.withColumn("round", F.row_number().over(by_root.orderBy(F.when(F.col("place") == F.col("champion"), 0).otherwise(F.col("place")))))
    shown = Window.orderBy("round", F.round("strongest", 9).desc(), "root_id")
    return rounds.withColumn("shown", F.row_number().over(shown)).drop("place", "champion")


def result_window(shown: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows and whether there were more, in ``more_available``."""
    more = shown.agg((F.max("shown") > limit).alias("more_available"))
    return shown.filter(F.col("shown") <= limit).crossJoin(F.broadcast(more))  # one row


def root_strength(candidates: DataFrame) -> DataFrame:
    """Strongest score and strongest primary score of each root."""
    return candidates.groupBy(F.coalesce("root_session_id", "session_id").alias("root_id")).agg(
        F.max("score").alias("strongest"), F.max(F.when(F.col("agent_scope") == "primary", F.col("score"))).alias("strongest_primary")
    )
