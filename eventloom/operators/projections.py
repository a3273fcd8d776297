"""Projections of an event: search body, shown content, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_CONTENT_BYTES, MAX_FACTS
from .filters import discovery_eligible

ACTIVITY = ("call_id", "protocol", "server", "tool", "arguments", "result_status", "result_text", "result_structured", "facts")
HIT_COLUMNS = ("event_id", "session_id", "parent_session_id", "root_session_id", "provider", "source_format", "provider_session_id", "event_sequence", "occurred_at_ms", "event_type", "role", "agent_scope", "custom_provider_key", "custom_source_id")


def body_search() -> Column:
    """All searchable text of an event, a line each; null if it isn't discoverable."""
    values = F.transform(F.coalesce("facts", F.array().cast("array<struct<kind:string,value:string>>")), lambda f: f["value"])
    again = F.col("result_text").eqNullSafe(F.col("body"))
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("body", "structured_content", "protocol", "server", "tool", "arguments", "result_status")]
    parts += [F.when(~again, F.nullif(F.col("result_text"), F.lit(""))), F.nullif(F.col("result_structured"), F.lit("")), F.array_compact(F.transform(values, lambda v: F.nullif(v, F.lit(""))))]
    return F.when(discovery_eligible(), F.nullif(F.concat_ws("\n", *parts), F.lit("")))


def content(events: DataFrame, mode: str) -> DataFrame:
    """``full``: all; ``text``: the body without structure and activity; ``none``: neither."""
    if mode == "full":
        return events
    dropped = {"text": ("structured_content", *ACTIVITY), "none": ("body", "structured_content", *ACTIVITY)}[mode]
    return events.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in dropped else F.col(f.name) for f in events.schema])


def hit_metadata(events: DataFrame) -> DataFrame:
    return events.select(*HIT_COLUMNS)


def compact_json(*columns: str) -> Column:
    """The columns as a JSON object without its nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def size_bounded(events: DataFrame, limit: int = MAX_CONTENT_BYTES, max_facts: int = MAX_FACTS) -> DataFrame:
    """Structured content goes where text and it are over the limit together, and
    facts end at their limit."""
    size = F.octet_length(F.coalesce("body", F.lit(""))) + F.octet_length(F.coalesce("structured_content", F.lit("")))
    return events.withColumn("structured_content", F.when(size <= limit, F.col("structured_content"))).withColumn("facts", F.slice("facts", 1, max_facts))


def json_lines(page: DataFrame, kind: str = "event") -> DataFrame:
    """A JSON record per row of a page and one completion record at the end."""
    rows = page.select(F.lit(0).alias("part"), F.to_json(F.struct(F.lit(kind).alias("record"), F.struct(*page.columns).alias(kind))).alias("line"))
    done = page.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("part"), F.to_json(F.struct(F.lit("completion").alias("record"), F.col("n").alias("events"))).alias("line"))
    return rows.unionByName(done).orderBy("part").select("line")
