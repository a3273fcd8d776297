"""Vectors beside a snapshot store, published and caught up in segments.

A publication writes one immutable segment: new chunks of events, keyed by event
and chunk with the hash of the text they stand for, and tombstones of events that
are gone. What a reader sees of an event is what the last segment that names it
says: an event's chunks are replaced as a whole. ``stale`` gives the texts that
have no vectors yet, so only these are embedded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..snapshots import Snapshots

CHUNKS = "event_id string, chunk_index int, source_text_hash string, embedding array<float>"
ROWS = f"{CHUNKS}, gone boolean"
MOST_SEGMENTS = 16  # more are merged by the next publication


class VectorStore:
    def __init__(self, store: Snapshots, name: str = "vectors"):
        self.store, self.root, self.name = store, f"{store.root}/{name}", name
        self.spark = store.spark

    def segments(self) -> list[str]:
        """Names of the segments, the oldest first."""
        text = self.store._read(f"{self.name}/segments.json")
        return json.loads(text)["segments"] if text else []

    def _rows(self, names: list[str]) -> DataFrame:
        """Rows and tombstones of the segments with their place in the order."""
        found = self.spark.createDataFrame([], f"{ROWS}, place int")
        for i, name in enumerate(names):
            found = found.unionByName(self.spark.read.schema(ROWS).parquet(f"{self.root}/{name}").withColumn("place", F.lit(i)))
        return found

    def _merged(self, names: list[str]) -> DataFrame:
        rows = self._rows(names)
        if len(names) < 2:
            return rows
        last = rows.select("event_id", "place").groupBy("event_id").agg(F.max("place").alias("place"))
        return rows.join(last, ["event_id", "place"], "left_semi")

    def read(self) -> DataFrame:
        """Live chunks: event_id, chunk_index, source_text_hash, embedding."""
        return self._merged(self.segments()).filter(~F.col("gone")).select("event_id", "chunk_index", "source_text_hash", "embedding")

    def publish(self, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> str:
        """Add a segment: ``fresh`` chunks replace all of their events', ``gone`` (event_id) bury theirs.

        A chunk given twice is an error. The list of segments is replaced last.
        """
        rows = self.spark.createDataFrame([], ROWS)
        if fresh is not None:
            rows = rows.unionByName(fresh.select("event_id", F.col("chunk_index").cast("int").alias("chunk_index"), "source_text_hash", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(False).alias("gone")))
        if gone is not None:
            buried = gone.select("event_id").distinct()
            if fresh is not None:
                buried = buried.join(fresh.select("event_id"), "event_id", "left_anti")
            rows = rows.unionByName(buried.select("event_id", F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("source_text_hash"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(True).alias("gone")))
        name = uuid.uuid4().hex
        rows.repartition("event_id").sortWithinPartitions("event_id").write.parquet(f"{self.root}/{name}")
        written = self.spark.read.schema(ROWS).parquet(f"{self.root}/{name}")
        twice = written.groupBy("event_id", "chunk_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()
        if twice:
            raise ValueError(f"chunks given twice: {[(r['event_id'], r['chunk_index']) for r in twice]}")
        names = [*self.segments(), name]
        if len(names) > MOST_SEGMENTS:
            whole = uuid.uuid4().hex
            live = self._merged(names).filter(~F.col("gone")).drop("place")  # nothing older is left that a tombstone has to hide
            live.repartition("event_id").sortWithinPartitions("event_id").write.parquet(f"{self.root}/{whole}")
            names = [whole]
        self.store._write(f"{self.name}/segments.json", json.dumps({"segments": names}))
        return name

    def stale(self, texts: DataFrame) -> DataFrame:
        """Rows of ``texts`` (event_id, chunk_index, source_text_hash, text) of events whose chunks aren't all there with these hashes."""
        held = self.read().groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "source_text_hash"))).alias("held"))
        wanted = texts.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(F.col("chunk_index").cast("int").alias("chunk_index"), "source_text_hash"))).alias("wanted"))
        behind = wanted.join(held, "event_id", "left").filter(~F.col("wanted").eqNullSafe(F.col("held"))).select("event_id")
        return texts.join(behind, "event_id", "left_semi")

    def gone(self, texts: DataFrame) -> DataFrame:
        """Events that have vectors and no text any more."""
        return self.read().select("event_id").distinct().join(texts.select("event_id").distinct(), "event_id", "left_anti")

    def catch_up(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Embed what is stale and bury what is gone, as one publication; how much that was.

        ``embed`` adds ``embedding`` to the stale rows; rows it leaves out stay stale.
        """
        path = self.store.work_path("embedded")
        embed(self.stale(texts)).select("event_id", "chunk_index", "source_text_hash", "embedding").write.parquet(path)  # embedded once
        fresh = self.spark.read.schema(CHUNKS).parquet(path)
        path = self.store.work_path("gone")
        self.gone(texts).write.parquet(path)
        gone = self.spark.read.parquet(path)
        done = {"embedded": fresh.count(), "gone": gone.count()}
        if any(done.values()):
            self.publish(fresh, gone)
        return done
