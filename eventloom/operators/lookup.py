"""Lookups by id, prefix and provider session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import id_prefix

MAX_IDS = 4096


def by_prefix(events: DataFrame, prefix: str) -> DataFrame:
    """At most two matches: one is an answer, two say that the prefix is ambiguous."""
    return events.filter(id_prefix(prefix)).orderBy("event_id").limit(2)


def by_ids(events: DataFrame, ids: list) -> DataFrame:
    """Events of the ids asked for, with ``ordinal``, their place in the request."""
    if len(ids) > MAX_IDS:
        raise ValueError(f"at most {MAX_IDS} ids")
    wanted = events.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in ids])).alias("ordinal", "__id"))
    return events.join(F.broadcast(wanted), F.col("event_id") == F.col("__id")).drop("__id")  # at most MAX_IDS rows


def all_found(found: DataFrame, ids: list) -> bool:
    """Whether no id of a batch is missing; one missing id voids the batch."""
    return found.select("ordinal").distinct().count() == len(ids)


def sessions_by_provider_id(events: DataFrame, provider_session_id: str, provider: str | None = None) -> DataFrame:
    """At most two sessions with a provider's session id."""
    rows = events.filter(F.col("provider_session_id") == provider_session_id.strip())
    if provider is not None:
        rows = rows.filter(F.col("provider") == provider)
    return rows.select("session_id", "provider").distinct().orderBy("session_id").limit(2)


def locate(events: DataFrame, prefix: str) -> DataFrame:
    """Where an event comes from: its session and source."""
    return by_prefix(events, prefix).select("event_id", "session_id", "provider", "source_format", "provider_session_id")


def shortest_unique(events: DataFrame, least: int = 8, column: str = "event_id") -> DataFrame:
    """Shortest prefix, of ``least`` characters at least, that names each id alone.

    In sorted order only neighbours can share the longest prefix. Ids are
    bucketed by their first ``least`` characters, as longer prefixes agree there.
    """
    w = Window.partitionBy(F.substring(column, 1, least)).orderBy(column)

    def common(a, b):
        n = F.length(a)
        same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
        return F.when(b.isNull(), F.lit(0)).otherwise(F.size(same))

    near = events.select(column).distinct().withColumn("__before", F.lag(column).over(w)).withColumn("__behind", F.lead(column).over(w))
    longest = F.greatest(common(F.col(column), F.col("__before")), common(F.col(column), F.col("__behind")), F.lit(least - 1))
    return near.select(column, F.substring(F.col(column), F.lit(1), longest + 1).alias("reference"))
