"""Roots of all sessions, counters of scans, vectors in segments."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import diagnostics, lineage
from eventloom.operators.vector_store import MOST_SEGMENTS, VectorStore
from eventloom.queries.ingest import shared_folder
from eventloom.snapshots import Snapshots


def plain_root(sessions, start, most):
    """The chain walked one session at a time."""
    chain, at = [], start
    while True:
        if at in chain or at not in sessions:
            return None
        chain.append(at)
        if sessions[at][0] is None:
            break
        if len(chain) > most:
            return None
        at = sessions[at][0]
    for i, s in enumerate(chain):
        claimed = sessions[s][1]
        if claimed is not None and not (claimed == s if i == len(chain) - 1 else claimed in chain[i + 1 :]):
            return None
    return chain[-1]


def test_proven_roots_of_all_sessions(spark):
    rng = random.Random(7)
    sessions = {}
    for i in range(300):
        parent = None if rng.random() < 0.1 else rng.randrange(max(i, 1)) if rng.random() < 0.9 else rng.choice([i, i + 1, 999])
        sessions[i] = (parent, None if rng.random() < 0.7 else parent if rng.random() < 0.6 else rng.randrange(300))
    for i in range(400, 480):
        sessions[i] = (None if i == 400 else i - 1, None)  # a chain of 80
    rows = [(f"s{i}", None if p is None else f"s{p}", None if c is None else f"s{c}") for i, (p, c) in sessions.items() for _ in range(rng.randrange(1, 4))]
    rows += [("twice", "s1", None), ("twice", "s2", None), ("below", "twice", None)]
    events = spark.createDataFrame(rows, "session_id string, parent_session_id string, root_session_id string")
    got = {r["session_id"]: r["proven_root"] for r in lineage.proven_roots(events).collect()}
    for i in sessions:
        want = plain_root(sessions, i, 64)
        assert got[f"s{i}"] == (None if want is None else f"s{want}"), i
    assert got["twice"] is None and got["below"] is None and len(got) == len(sessions) + 2
    assert got["s464"] == "s400" and got["s465"] is None
    assert lineage.proven_root(events, "s464") == "s400" and lineage.proven_root(events, "nobody") is None


def test_counters_of_a_vector_scan(spark):
    nan = float("nan")
    rows = [("a", 0, [1.0, 0.0]), ("a", 1, [0.6, 0.8]), ("b", 0, [-1.0, 0.0]), ("c", 0, [0.0, 1.0]), ("d", 0, [nan, 1.0]), ("d", 1, [1.0]), ("e", 0, [0.8, 0.6]), ("f", 0, None)]
    chunks = spark.createDataFrame(rows, "event_id string, chunk_index int, embedding array<float>")
    hits, seen = diagnostics.vector_scan(chunks, [1.0, 0.0], 1)
    assert [(r["event_id"], r["chunk_index"]) for r in hits.collect()] == [("a", 0)]
    assert seen.get == {"events_seen": 6, "events_scored": 4, "filtered_events": 0, "chunks_seen": 8, "chunks_scanned": 5, "chunks_skipped": 3, "vector_bytes_read": 40, "non_positive_events": 2, "rejected_events": 1}
    some = spark.createDataFrame([("e",), ("e",), ("d",)], "event_id string")
    hits, seen = diagnostics.vector_scan(chunks, [1.0, 0.0], 5, some)
    assert [r["event_id"] for r in hits.collect()] == ["e"]
    assert (seen.get["filtered_events"], seen.get["chunks_scanned"], seen.get["rejected_events"]) == (4, 1, 0)
    hits, seen = diagnostics.vector_scan(chunks.limit(0), [1.0, 0.0], 5)
    assert hits.collect() == [] and set(seen.get.values()) == {0}


def test_vectors_are_replaced_buried_and_merged(spark):
    store = VectorStore(Snapshots(spark, shared_folder(spark, "store")))
    schema = "event_id string, chunk_index int, source_text_hash string, embedding array<float>"
    chunk = lambda *rows: spark.createDataFrame([(e, i, h, [float(i), math.pi]) for e, i, h in rows], schema)
    assert store.read().count() == 0
    store.publish(chunk(("a", 0, "h1"), ("a", 1, "h1"), ("b", 0, "h1")))
    store.publish(chunk(("a", 0, "h2")))
    live = lambda: sorted((r["event_id"], r["chunk_index"], r["source_text_hash"]) for r in store.read().collect())
    assert live() == [("a", 0, "h2"), ("b", 0, "h1")]
    store.publish(gone=spark.createDataFrame([("b",), ("b",)], "event_id string"))
    assert live() == [("a", 0, "h2")]
    store.publish(chunk(("b", 0, "h3")), spark.createDataFrame([("b",)], "event_id string"))
    assert live() == [("a", 0, "h2"), ("b", 0, "h3")]  # back again
    before = store.segments()
    with pytest.raises(ValueError, match="twice"):
        store.publish(chunk(("c", 0, "h"), ("c", 0, "h")))
    assert store.segments() == before
    for n in range(MOST_SEGMENTS):
        store.publish(chunk(("n", 0, f"v{n}")))
    assert len(store.segments()) < MOST_SEGMENTS and live() == [("a", 0, "h2"), ("b", 0, "h3"), ("n", 0, f"v{MOST_SEGMENTS - 1}")]


def test_only_stale_texts_are_embedded(spark):
    store = VectorStore(Snapshots(spark, shared_folder(spark, "store")))
    texts = lambda *rows: spark.createDataFrame(rows, "event_id string, chunk_index int, source_text_hash string, text string")
    asked = []

    def embed(rows):
        asked.append(sorted((r["event_id"], r["chunk_index"]) for r in rows.collect()))
        return rows.withColumn("embedding", F.array(F.lit(1.0).cast("float")))

    first = [("a", 0, "1", "x"), ("a", 1, "1", "y"), ("b", 0, "2", "z"), ("c", 0, "3", "w")]
    assert store.catch_up(texts(*first), embed) == {"embedded": 4, "gone": 0}
    assert store.catch_up(texts(*first), embed) == {"embedded": 0, "gone": 0} and len(store.segments()) == 1
    # a lost its second chunk, b changed, c is gone, d is new
    second = [("a", 0, "1", "x"), ("b", 0, "9", "zz"), ("d", 0, "4", "v")]
    assert store.catch_up(texts(*second), embed) == {"embedded": 3, "gone": 1}
    assert asked == [[("a", 0), ("a", 1), ("b", 0), ("c", 0)], [], [("a", 0), ("b", 0), ("d", 0)]]
    assert sorted((r["event_id"], r["source_text_hash"]) for r in store.read().collect()) == [("a", "1"), ("b", "9"), ("d", "4")]
