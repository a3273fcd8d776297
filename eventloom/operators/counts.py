"""Counts over events: totals, sources and order-free content sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import content_leaf, leaf_sum


def session_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("session_id").alias("sessions"))


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def status_totals(events: DataFrame) -> DataFrame:
    """Documents, sessions, messages and events that may be embedded."""
    message = F.col("event_type") == "message"
    return events.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(message).alias("messages"),
        F.count_if(message & (F.col("role") == "user")).alias("semantic_eligible"),
    )


def source_totals(events: DataFrame) -> DataFrame:
    """Counts that a manifest keeps of every source."""
    return events.groupBy("source_key").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("session_id").alias("sessions"),
        F.sum(F.octet_length(F.coalesce("body", F.lit("")))).cast("long").alias("body_bytes"),
        F.count_if(F.coalesce("policy_status", F.lit("selected")) != "selected").alias("withheld"),
    )


def content_sums(events: DataFrame) -> DataFrame:
    """A sum of record digests per source: equal for equal records in any order, and
    of a union the sum of the sums."""
    leaf = content_leaf(*[F.col(c).cast("string") for c in ("event_id", "session_id", "event_sequence", "event_type", "role", "body")])
    return events.groupBy("source_key").agg(leaf_sum(leaf).alias("content_sum"))
