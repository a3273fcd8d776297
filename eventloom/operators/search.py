"""Lexical search: BM25 over tokens with class weights and coverage.

No index and no shuffle of the corpus: one pass sums document frequencies and
lengths for the terms of the query (at most 32 numbers, one row), a second one
scores and keeps the best k. Both read the token column alone; bodies are
fetched for the winners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_term, class_weight, idf, length_code, length_of_code, term_frequencies

POOL = 4096
TIE = 1e-12


def with_tokens(events: DataFrame, body: str = "body") -> DataFrame:
    """Add ``tokens`` and ``doc_len``, as a snapshot keeps them."""
    from ..functions.text import tokens

    return events.withColumn("tokens", tokens(F.coalesce(F.col(body), F.lit("")))).withColumn("doc_len", F.size("tokens"))


def collection_stats(events: DataFrame, terms: list[str]) -> DataFrame:
    """One row: documents, mean length and document frequency of each term."""
    return events.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg("doc_len").alias("mean_len"),
        *[F.sum(F.array_contains("tokens", t).cast("long")).alias(f"df_{i}") for i, t in enumerate(terms)],
    )


def lexical_scores(events: DataFrame, corpus: DataFrame, terms: list[str], scope: str | None = None, byte_lengths: bool = False) -> DataFrame:
    """``events`` that hold a term, with ``coverage`` (distinct terms) and ``score``.

    Statistics come from ``corpus``: a filter narrows the events, not the score.
    ``byte_lengths``: events are as long as one byte tells, as in an index.
    """
    if not terms:
        return events.limit(0).withColumn("coverage", F.lit(0)).withColumn("score", F.lit(0.0))
    stats = collection_stats(corpus, terms)
    hit = events.filter(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in terms]))).withColumn("__tf", term_frequencies(F.col("tokens"), terms))
    scored = hit.crossJoin(F.broadcast(stats))  # stats is one row
    length = length_of_code(length_code(F.col("doc_len"))) if byte_lengths else F.col("doc_len")
    parts = [F.when(F.get("__tf", F.lit(i)) > 0, bm25_term(F.get("__tf", F.lit(i)).cast("double"), idf(F.col("n_docs"), F.col(f"df_{i}")), length, F.col("mean_len"))).otherwise(0.0) for i in range(len(terms))]
    total: Column = parts[0]
    for p in parts[1:]:
        total = total + p
    if scope is not None:
        total = total * class_weight(F.col("event_type"), scope)
    covered = F.size(F.filter("__tf", lambda n: n > 0))
    return scored.withColumn("coverage", covered).withColumn("score", total).drop("__tf", "n_docs", "mean_len", *[f"df_{i}" for i in range(len(terms))])


def best_scores(scored: DataFrame, k: int, id_column: str = "event_id") -> DataFrame:
    """Top k by score, then id."""
    return scored.orderBy(F.round("score", 9).desc(), F.col(id_column).asc()).limit(k)


def coverage_pool(scored: DataFrame, k: int = POOL, id_column: str = "event_id") -> DataFrame:
    """Top k by coverage tiers: more distinct terms first, then score, then id."""
    return scored.orderBy(F.col("coverage").desc(), F.round("score", 9).desc(), F.col(id_column).asc()).limit(k)


def final_order() -> list[Column]:
    """Order of shown candidates; untimed ones are last among equals."""
    return [F.round("score", 9).desc(), F.col("occurred_at_ms").desc_nulls_last(), F.col("event_sequence").desc(), F.col("event_id").asc()]


def metadata_pool(events: DataFrame, k: int = POOL) -> DataFrame:
    """Candidates of a search without text: equal scores, chosen by id."""
    return events.withColumn("score", F.lit(1.0)).orderBy("event_id").limit(k)


def document_frequencies(events: DataFrame) -> DataFrame:
    """(term, doc_freq, term_count) over all tokens."""
    return (
        events.select("event_id", F.explode("tokens").alias("term"))
        .groupBy("event_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("term_count"))
    )
