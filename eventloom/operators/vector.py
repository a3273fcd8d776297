"""Exact vector search and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot

MAX_HITS = 4096
RRF_K = 60
SEMANTIC_WEIGHT = 0.35
FUSION_POOL = 1600


def similarities(chunks: DataFrame, query: list[float], vector_column: str = "embedding") -> DataFrame:
    """``chunks`` with ``similarity`` to the query; not finite and not positive ones go."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.withColumn("similarity", dot(F.col(vector_column), q))
    return scored.filter((F.col("similarity") > 0) & ~F.isnan("similarity") & (F.col("similarity") < float("inf")))


def best_chunks(scored: DataFrame, id_column: str = "event_id", chunk_column: str = "chunk_index") -> DataFrame:
    """Best chunk of each event; ties go to the lower chunk."""
    best = F.max(F.struct(F.col("similarity"), (-F.col(chunk_column)).alias("neg")))
    return scored.groupBy(id_column).agg(best.alias("b")).select(id_column, F.col("b.similarity").alias("similarity"), (-F.col("b.neg")).alias(chunk_column))


def top_vectors(scored: DataFrame, k: int, id_column: str = "event_id") -> DataFrame:
    if not 1 <= k <= MAX_HITS:
        raise ValueError(f"k must be in 1..{MAX_HITS}")
    return scored.orderBy(F.round("similarity", 12).desc(), F.col(id_column)).limit(k)


def eligible(chunks: DataFrame, ids: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Only chunks of the events in ``ids``."""
    return chunks.join(ids.select(id_column), id_column, "left_semi")


def best_over_alternatives(scored: DataFrame, id_column: str = "event_id", score_column: str = "score") -> DataFrame:
    """One score per event over the alternatives of a query: the largest."""
    return scored.groupBy(id_column).agg(F.max(score_column).alias(score_column))


def ranked(pool: DataFrame, score_column: str, name: str, id_column: str = "event_id") -> DataFrame:
    """1-based positions in a pool of bounded size."""
    w = Window.orderBy(F.round(score_column, 9).desc(), F.col(id_column))
    return pool.select(id_column, F.row_number().over(w).alias(name))


def fuse(lexical: DataFrame, semantic: DataFrame, weight: float = SEMANTIC_WEIGHT, id_column: str = "event_id") -> DataFrame:
    """Weighted reciprocal ranks of two ranked pools (``lexical_rank``, ``semantic_rank``).

    An event that one pool lacks gets nothing from that side.
    """
    if not 0.0 <= weight <= 1.0:
        raise ValueError("the weight is a share")
    both = lexical.join(semantic, id_column, "full_outer")
    score = F.coalesce((1.0 - weight) / (RRF_K + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(weight / (RRF_K + F.col("semantic_rank")), F.lit(0.0))
    return both.withColumn("score", score)
