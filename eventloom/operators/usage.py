"""Usage counters: upsert, retention, summaries and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("day_utc", "definition_version", "tool_version", "surface", "operation", "outcome", "value_class", "duration_bucket", "context_coverage")
MEASURES = ("calls", "result_count", "delivered_output_bytes", "delivered_context_bytes", "matched_session_bytes")
DURATION_BUCKETS = ("lt_10ms", "lt_100ms", "lt_1s", "lt_10s", "ge_10s")


def duration_bucket(ms: Column) -> Column:
    return F.when(ms < 10, "lt_10ms").when(ms < 100, "lt_100ms").when(ms < 1000, "lt_1s").when(ms < 10_000, "lt_10s").otherwise("ge_10s")


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters of both tables added by key."""
    both = base.select(*KEY, *MEASURES).unionByName(delta.select(*KEY, *MEASURES))
    return both.groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in MEASURES])


def retained(rows: DataFrame, cutoff_day: str) -> DataFrame:
    return rows.filter(F.col("day_utc") >= cutoff_day)


def summary(rows: DataFrame) -> DataFrame:
    """One row of twelve conditional sums; none is null."""
    total = lambda measure, test=None: F.coalesce(F.sum(F.col(measure) if test is None else F.when(test, F.col(measure)).otherwise(0)), F.lit(0))
    ok, useful, complete = F.col("outcome") == "success", F.col("value_class") == "useful", F.col("context_coverage") == "complete"
    return rows.agg(
        total("calls").alias("calls"),
        total("calls", ok).alias("succeeded"),
        total("calls", F.col("outcome") == "error").alias("failed"),
        total("calls", useful).alias("useful_calls"),
        total("calls", F.col("value_class") == "empty").alias("empty_calls"),
        total("calls", complete).alias("complete_calls"),
        total("result_count").alias("results"),
        total("delivered_output_bytes").alias("output_bytes"),
        total("delivered_context_bytes").alias("context_bytes"),
        total("delivered_context_bytes", complete).alias("complete_context_bytes"),
        total("matched_session_bytes", complete).alias("complete_matched_bytes"),
        total("calls", ~ok & ~useful).alias("other_calls"),
    )


def active_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("day_utc").alias("first_day"), F.max("day_utc").alias("last_day"), F.count_distinct("day_utc").alias("active_days"))


def by_operation(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tool_version", "surface", "operation").agg(*[F.sum(m).alias(m) for m in MEASURES])


def duration_histogram(rows: DataFrame) -> DataFrame:
    """Calls by bucket, with each bucket's place in order."""
    names = F.array(*[F.lit(b) for b in DURATION_BUCKETS])
    return rows.groupBy("duration_bucket").agg(F.sum("calls").alias("calls")).withColumn("place", F.array_position(names, F.col("duration_bucket")))


def versions(rows: DataFrame) -> DataFrame:
    return rows.select("definition_version", "tool_version").distinct()


def token_range(size: Column) -> list[Column]:
    """Floors of bytes / 5, bytes / 4 and bytes * 2 / 5."""
    return [F.floor(size / 5).alias("tokens_low"), F.floor(size / 4).alias("tokens_mid"), F.floor(size * 2 / 5).alias("tokens_high")]


def avoided_bytes(matched: Column, delivered: Column, complete_calls: Column) -> Column:
    """Matched less delivered bytes; null without complete calls, an error if negative."""
    gain = matched - delivered
    return F.when(complete_calls > 0, F.when(gain < 0, F.raise_error(F.lit("delivered more than was matched")).cast("long")).otherwise(gain))
