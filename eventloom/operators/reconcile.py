"""Which derived rows to make anew: a comparison of two keyed states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(current: DataFrame, known: DataFrame) -> DataFrame:
    """(key, change) of rows (key, digest): new, stale, unchanged or gone."""
    was = known.select(F.col("key").alias("__key"), F.col("digest").alias("__digest"))
    both = current.join(was, F.col("key") == F.col("__key"), "full_outer")
    change = F.when(F.col("__key").isNull(), "new").when(F.col("key").isNull(), "gone").when(F.col("digest") == F.col("__digest"), "unchanged").otherwise("stale")
    return both.select(F.coalesce("key", "__key").alias("key"), change.alias("change"))


def to_embed(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents whose (event_id, source_text_hash) has no vectors yet."""
    return documents.join(vectors.select("event_id", "source_text_hash").distinct(), ["event_id", "source_text_hash"], "left_anti")


def replaced(base: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors after a refresh: events with new chunks or tombstones lose their old ones."""
    touched = fresh.select("event_id").unionByName(gone.select("event_id")).distinct()
    return base.join(touched, "event_id", "left_anti").unionByName(fresh)
