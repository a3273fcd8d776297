"""What a scan saw and left out, counted while it runs.

The counters are observed metrics of the scan's own plan: they come with its
result and cost no pass of their own. Read them after an action on the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .search import lexical_scores
from .vector import MAX_HITS, top_vectors

FLOAT_BYTES = 4


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def vector_scan(chunks: DataFrame, query: list[float], k: int, eligible: DataFrame | None = None, id_column: str = "event_id", chunk_column: str = "chunk_index", vector_column: str = "embedding") -> tuple[DataFrame, Observation]:
    """The k events most similar to ``query`` by their best chunk, and the scan's counters.

    ``eligible``: only the events it names are scored, those it doesn't are counted
    as filtered. Chunks of another length than the query's, and those that aren't
    finite, are invalid; events whose best similarity isn't above 0 aren't hits.
    """
    if not 1 <= k <= MAX_HITS:
        raise ValueError(f"k must be in 1..{MAX_HITS}")
    allowed = F.lit(True)
    rows = chunks
    if eligible is not None:
        rows = chunks.join(eligible.select(id_column).distinct().withColumn("__allowed", F.lit(True)), id_column, "left")
        allowed = F.coalesce("__allowed", F.lit(False))
    v = F.col(vector_column)
    sound = v.isNotNull() & (F.size(v) == len(query)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scanned = allowed & F.coalesce(sound, F.lit(False))
    similarity = F.when(scanned, dot(v, F.array(*[F.lit(float(x)) for x in query])))
    best = F.max(F.when(scanned, F.struct(similarity.alias("similarity"), (-F.col(chunk_column)).alias("neg"))))
    by_event = rows.groupBy(id_column).agg(
        best.alias("b"),
        F.count(F.lit(1)).alias("chunks"),
        F.count(F.when(scanned, 1)).alias("scanned"),
        F.bool_or(allowed).alias("allowed"),
    )
    hit = F.coalesce(F.col("b.similarity") > 0, F.lit(False))
    seen = Observation()
    watched = by_event.observe(
        seen,
        F.count(F.lit(1)).alias("events_seen"),
        _total((F.col("scanned") > 0).cast("long")).alias("events_scored"),
        _total((~F.col("allowed")).cast("long")).alias("filtered_events"),
        _total(F.col("chunks")).alias("chunks_seen"),
        _total(F.col("scanned")).alias("chunks_scanned"),
        _total(F.col("chunks") - F.col("scanned")).alias("chunks_skipped"),
        _total(F.col("scanned") * (FLOAT_BYTES * len(query))).alias("vector_bytes_read"),
        _total((~hit & (F.col("scanned") > 0)).cast("long")).alias("non_positive_events"),
        F.greatest(_total(hit.cast("long")) - k, F.lit(0)).cast("long").alias("rejected_events"),
    )
    hits = watched.filter(hit).select(id_column, F.col("b.similarity").alias("similarity"), (-F.col("b.neg")).alias(chunk_column))
    return top_vectors(hits, k, id_column), seen


def lexical_scan(events: DataFrame, corpus: DataFrame, terms: list[str], scope: str | None = None) -> tuple[DataFrame, Observation]:
    """``search.lexical_scores`` with counters of the events that hold a term."""
    seen = Observation()
    scored = lexical_scores(events, corpus, terms, scope).observe(
        seen,
        F.count(F.lit(1)).alias("events_scored"),
        _total(F.col("doc_len")).alias("tokens_scored"),
        _total((F.col("coverage") == len(terms)).cast("long")).alias("events_with_all_terms"),
        F.coalesce(F.max("coverage"), F.lit(0)).cast("long").alias("greatest_coverage"),
    )
    return scored, seen
