"""Pools of candidates no larger than an answer needs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import POOL
from .segments import SegmentedIndex
from .shaping import PRIMARY_TOLERANCE, root_strength

OVERSAMPLE, LEAST_POOL = 8, 256


@dataclass
class Candidates:
    pool: DataFrame
    truncated: bool  # whether the largest pool still didn't settle the answer
    sizes: list[int] = field(default_factory=list)  # the pools that were tried
    blocks: int = 0
    blocks_read: int = 0  # by the last of them


def decisive(pool: DataFrame, limit: int, by_session: bool) -> bool:
    """Whether events that score no more than the pool's least can't change the first ``limit`` results.

    For results by session every one of the first roots must stand above the
    pool's least score, and so must the champion that a root shows: its
    strongest primary event if that is within the tolerance, and if it has none,
    the score that one would need.
    """
    tail = pool.agg(F.min("score").alias("tail"), F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions")).first()
    if not by_session:
        return tail["events"] > limit
    if tail["sessions"] <= limit:
        return False
    needed = F.col("strongest") * PRIMARY_TOLERANCE
    holds = F.when(F.col("strongest_primary") >= needed, F.col("strongest_primary")).otherwise(needed)
    first = root_strength(pool).orderBy(F.desc("strongest"), "root_id").limit(limit)
    facts = first.agg(F.count(F.lit(1)).alias("n"), F.min(F.least("strongest", holds)).alias("least")).first()
    return facts["n"] == limit and facts["least"] > tail["tail"]


def candidates(index: SegmentedIndex, terms: list[str], limit: int, rows: DataFrame, scope: str | None = None, by_session: bool = True, most: int = POOL, tiers: bool = True) -> Candidates:
    """A pool of ``rows`` that settles the first ``limit`` results: 8 times as many
    as wanted, 256 at least, doubled until it is decisive or holds all there is, up
    to ``most``. ``tiers``: events with more of the terms enter the pool first."""
    size, sizes = min(max(OVERSAMPLE * limit, LEAST_POOL), most), []
    while True:
        sizes.append(size)
        found = index.best(terms, size, rows, scope, tiers)
        path = index.store.work_path("candidates")
        found.pool.write.parquet(path)
        pool = index.spark.read.schema(found.pool.schema).parquet(path)
        settled = pool.count() < size or decisive(pool, limit, by_session)
        if settled or size >= most:
            return Candidates(pool, not settled, sizes, found.blocks, found.blocks_read)
        size = min(2 * size, most)
