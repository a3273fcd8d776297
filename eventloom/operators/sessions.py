"""Reads of sessions: first events, windows around an event, and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_WINDOW, MAX_PREFIX = 101, 4097


def session_order() -> list[Column]:
    """Sequence, then time with untimed first, then id."""
    return [F.col("event_sequence").asc(), F.col("occurred_at_ms").asc_nulls_first(), F.col("event_id").asc()]


def _in_session() -> Window:
    return Window.partitionBy("session_id").orderBy(*session_order())


def session_records(events: DataFrame) -> DataFrame:
    """One row per session: its first event's columns."""
    order = F.struct("event_sequence", F.coalesce("occurred_at_ms", F.lit(-(1 << 62))).alias("ms"), "event_id")
    first = events.groupBy("session_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "session_id"]), order).alias("e"))
    return first.select("session_id", "e.*")


def prefix(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events of every session in ``events``."""
    if not 1 <= n <= MAX_PREFIX:
        raise ValueError(f"n must be in 1..{MAX_PREFIX}")
    return events.withColumn("place", F.row_number().over(_in_session())).filter(F.col("place") <= n)


def window_around(events: DataFrame, event_id, before: int, after: int) -> DataFrame:
    """Events of the anchor's session from ``before`` places ahead of it to ``after`` behind."""
    if before < 0 or after < 0 or before + after + 1 > MAX_WINDOW:
        raise ValueError(f"a window holds {MAX_WINDOW} events at most")
    anchor_session = events.filter(F.col("event_id") == event_id).select("session_id").distinct()
    mine = events.join(anchor_session, "session_id", "left_semi").withColumn("place", F.row_number().over(_in_session()))
    anchor = F.max(F.when(F.col("event_id") == event_id, F.col("place"))).over(Window.partitionBy("session_id"))
    return mine.withColumn("distance", F.col("place") - anchor).filter(F.col("distance").between(-before, after)).drop("place")


def full_mode(events: DataFrame) -> DataFrame:
    return events.filter((F.col("event_type") == "message") & F.col("role").isin("user", "assistant", "system"))


def lite_mode(events: DataFrame) -> DataFrame:
    """User messages and, before each and at the end, the last assistant message."""
    talk = events.filter((F.col("event_type") == "message") & F.col("role").isin("user", "assistant"))
    following = F.lead("role").over(_in_session())
    return talk.withColumn("__next", following).filter((F.col("role") == "user") | F.col("__next").isNull() | (F.col("__next") == "user")).drop("__next")


def with_mode(events: DataFrame, mode: str) -> DataFrame:
    return {"full": full_mode, "lite": lite_mode, "log": lambda e: e}[mode](events)


def session_page(events: DataFrame, session_id, mode: str, limit: int) -> DataFrame:
    """A page of one session; the mode comes before the limit."""
    return with_mode(events.filter(F.col("session_id") == session_id), mode).orderBy(*session_order()).limit(limit)


def turns(events: DataFrame) -> DataFrame:
    """Each user message with the last assistant message that has text before the next one.

    (session_id, event_id, body, occurred_at_ms, assistant_text, assistant_ms).
    """
    talk = events.filter((F.col("event_type") == "message") & F.col("role").isin("user", "assistant"))
    turn = F.sum((F.col("role") == "user").cast("int")).over(_in_session())
    answer = (F.col("role") == "assistant") & (F.trim(F.coalesce("body", F.lit(""))) != "")
    place = F.struct("event_sequence", F.coalesce("occurred_at_ms", F.lit(-(1 << 62))).alias("ms"), "event_id")
    said = F.when(answer, F.struct("body", "occurred_at_ms"))
    return (
        talk.withColumn("turn_no", turn)
        .filter("turn_no > 0")
        .groupBy("session_id", "turn_no")
        .agg(
            F.max(F.when(F.col("role") == "user", F.struct("event_id", "body", "occurred_at_ms"))).alias("u"),
            F.max_by(said, F.when(answer, place)).alias("a"),
        )
        .select("session_id", "turn_no", "u.event_id", "u.body", "u.occurred_at_ms", F.col("a.body").alias("assistant_text"), F.col("a.occurred_at_ms").alias("assistant_ms"))
    )


def order_violations(events: DataFrame) -> DataFrame:
    """Events whose id stands twice in their session's order; there should be none."""
    return events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
