"""Enumeration of events in a total order, page by page.

The order: timed before untimed, time, sequence, full digest; descending is the
exact reverse. A page is a filter on the order tuple and a top-n, so it never
sorts more than a partition's best rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import EventFilters

MAX_PAGE = 4096
DEFAULT_LIMIT, MAX_LIMIT = 10_000, 10_000_000
MAX_CURSOR_CHARS = 512
KEYS = ("occurred_at_ms", "event_sequence", "event_digest")


def range_order(descending: bool = False) -> list[Column]:
    if descending:
        return [F.col("occurred_at_ms").desc_nulls_first(), F.col("event_sequence").desc(), F.col("event_digest").desc()]
    return [F.col("occurred_at_ms").asc_nulls_last(), F.col("event_sequence").asc(), F.col("event_digest").asc()]


def after(key: tuple, descending: bool = False) -> Column:
    """Rows strictly behind ``key`` (ms or None, sequence, digest) in the order."""
    ms, sequence, digest = key
    timed = F.col("occurred_at_ms")
    if descending:
        tail = (F.col("event_sequence") < sequence) | ((F.col("event_sequence") == sequence) & (F.col("event_digest") < digest))
        return timed.isNotNull() | tail if ms is None else timed.isNotNull() & ((timed < ms) | ((timed == ms) & tail))
    tail = (F.col("event_sequence") > sequence) | ((F.col("event_sequence") == sequence) & (F.col("event_digest") > digest))
    return timed.isNull() & tail if ms is None else timed.isNull() | (timed > ms) | ((timed == ms) & tail)


def page(events: DataFrame, limit: int, cursor: tuple | None = None, descending: bool = False) -> DataFrame:
    """The next ``limit`` events behind ``cursor``."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be in 1..{MAX_LIMIT}")
    rows = events if cursor is None else events.filter(after(cursor, descending))
    return rows.orderBy(*range_order(descending)).limit(limit)


def within_budget(rows: DataFrame, budget: int, size_column: str = "content_bytes", descending: bool = False, strict: bool = False) -> DataFrame:
    """The leading rows of a page whose bytes fit the budget together.

    The first row is always let in, so a single oversized event can't stop the
    enumeration; ``strict`` refuses that too. A page is bounded by ``MAX_PAGE``.
    """
    w = Window.orderBy(*range_order(descending))
    run = rows.withColumn("__sum", F.sum(size_column).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__nth", F.row_number().over(w))
    fits = F.col("__sum") <= budget
    return run.filter(fits if strict else fits | (F.col("__nth") == 1)).drop("__sum", "__nth")


def selection_digest(filters: EventFilters, descending: bool) -> str:
    return hashlib.sha256(json.dumps([asdict(filters.canonical()), descending], sort_keys=True).encode()).hexdigest()[:32]


def encode_cursor(generation: str, filters: EventFilters, key: tuple, descending: bool = False) -> str:
    body = json.dumps([generation, selection_digest(filters, descending), *key]).encode()
    text = base64.urlsafe_b64encode(zlib.crc32(body).to_bytes(4, "big") + body).decode().rstrip("=")
    if len(text) > MAX_CURSOR_CHARS:
        raise ValueError("cursor too long")
    return text


def decode_cursor(text: str, generation: str, filters: EventFilters, descending: bool = False) -> tuple:
    """The key in a cursor; stale and foreign cursors are errors, never restarts."""
    if len(text) > MAX_CURSOR_CHARS:
        raise ValueError("cursor too long")
    raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    if zlib.crc32(raw[4:]).to_bytes(4, "big") != raw[:4]:
        raise ValueError("cursor is damaged")
    found, selection, *key = json.loads(raw[4:])
    if found != generation:
        raise ValueError("cursor belongs to another generation")
    if selection != selection_digest(filters, descending):
        raise ValueError("cursor belongs to another selection")
    return tuple(key)


def source_order() -> list[Column]:
    return [F.col("source_key").asc(), F.col("event_digest").asc()]


def semantic_order() -> list[Column]:
    return [F.col("event_digest").asc()]


def keyset_page(rows: DataFrame, keys: list[str], limit: int, cursor: tuple | None = None) -> DataFrame:
    """A page by plain ascending keys (by source, by session, by digest)."""
    if cursor is not None:
        ahead, equal = F.lit(False), F.lit(True)
        for name, value in zip(keys, cursor, strict=True):
            ahead, equal = ahead | (equal & (F.col(name) > value)), equal & (F.col(name) == value)
        rows = rows.filter(ahead)
    return rows.orderBy(*keys).limit(min(limit, MAX_PAGE))
