"""The growing index against plain BM25, and pools against whole results."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.functions.text import length_code, length_of_code
from eventloom.operators import adaptive, shaping
from eventloom.operators.segments import MERGE, SegmentedIndex
from eventloom.plans.history import History
from eventloom.queries.ingest import shared_folder
from eventloom.schema import conform
from eventloom.snapshots import Snapshots


def coded(n):
    """The length that one byte keeps: four binary digits of what is over 24."""
    over = n - 24
    cut = max(over.bit_length() - 4, 0)
    return n if n < 40 else 24 + (over >> cut << cut)


def plain(texts, terms, k, tiers=False, allowed=None):
    """[(id, coverage, score)] of the k best."""
    counts = {i: Counter(t.split()) for i, t in texts.items()}
    mean = sum(c.total() for c in counts.values()) / len(counts)
    df = {t: sum(t in c for c in counts.values()) for t in terms}
    found = []
    for i, c in counts.items():
        held = [t for t in terms if c[t]]
        if held and (allowed is None or i in allowed):
            length = 1.2 * (0.25 + 0.75 * coded(c.total()) / mean)
            found.append((i, len(held), sum(math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + length) for t in held)))
    found.sort(key=lambda x: ((-x[1],) if tiers else ()) + (-round(x[2], 9), x[0]))
    return found[:k]


def rows_of(df):
    return [(r["event_id"], r["coverage"], r["score"]) for r in df.collect()]


def same(got, want):
    assert [(i, c) for i, c, _ in got] == [(i, c) for i, c, _ in want]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return {f"{i:06d}": " ".join(rng.choices(words, weights, k=rng.choice([4, 8, 20, 60, 200]))) for i in range(n)}


def events(spark, texts, sources=5):
    rows = [(f"s{int(i) % sources}", i, f"session {int(i) % 97:03d}", int(i), "message", "selected", t) for i, t in texts.items()]
    return conform(spark.createDataFrame(rows, "source_key string, event_id string, session_id string, event_sequence long, event_type string, policy_status string, body string"))


def test_lengths_in_one_byte(spark):
    numbers = spark.range(1, 70_000).select(F.col("id").cast("int").alias("n"))
    seen = numbers.select("n", length_code(F.col("n")).alias("c")).select("n", "c", length_of_code(F.col("c")).alias("back")).collect()
    assert all(r["back"] == coded(r["n"]) and 0 <= r["c"] < 256 for r in seen)
    top = spark.range(1).select(length_code(F.lit(2**31 - 1)).alias("c")).first()["c"]
    assert top == 255


def test_publications_replacements_and_merges(spark):
    store = Snapshots(spark, shared_folder(spark, "store"))
    texts = corpus(900, 1)
    part = lambda k: {i: t for i, t in texts.items() if int(i) % 5 in k}
    live, written = {}, []
    terms = ["w3", "w40", "w7", "unknown"]
    for step in range(7):
        changed = {i: t for i, t in part([step % 5]).items() if step < 5 or int(i) % 2}
        if step == 4:
            store.publish(delete=["s0"])
            live = {i: t for i, t in live.items() if int(i) % 5 != 0}
            changed = {}
        else:
            store.publish(replace=events(spark, changed))
            live = {i: t for i, t in live.items() if int(i) % 5 != step % 5} | changed
        index = SegmentedIndex.update(store)
        written.append(index.written)
        assert index.written == sum(len(set(t.split())) for t in changed.values())
        assert index.n_docs == len(live) and index.total_length == sum(len(t.split()) for t in live.values())
        assert max(Counter(s.tier for s in index.segments).values(), default=0) < MERGE
        if step in (2, 4, 6):
            same(rows_of(index.best(terms, 20).pool), plain(live, terms, 20))
    assert SegmentedIndex.update(store).segments == index.segments  # found, not made
    fresh = Snapshots(spark, shared_folder(spark, "store"))
    fresh.publish(replace=events(spark, live))
    assert rows_of(SegmentedIndex.update(fresh).best(terms, 30, tiers=True).pool) == rows_of(index.best(terms, 30, tiers=True).pool)
    # a segment that a crashed update left behind is never read
    store.publish(notes={"only": "notes"})
    kept, store._write = store._write, lambda *_: (_ for _ in ()).throw(OSError("crash"))
    with pytest.raises(OSError):
        SegmentedIndex.update(store)
    store._write = kept
    assert SegmentedIndex.update(store).written == 0


@pytest.fixture(scope="module")
def large(spark):
    store = Snapshots(spark, shared_folder(spark, "store"))
    texts = corpus(6000, 2)
    store.publish(replace=events(spark, texts))
    return store, SegmentedIndex.update(store), texts


def test_most_blocks_are_skipped_and_none_that_counts(spark, large):
    store, index, texts = large
    for terms, k, tiers in ((["w0", "w1", "w2"], 20, False), (["w5", "w100", "w30"], 20, False), (["w0", "w50"], 40, True), (["w399"], 5, False)):
        found = index.best(terms, k, tiers=tiers)
        same(rows_of(found.pool), plain(texts, terms, k, tiers))
        assert found.blocks_read <= found.blocks
    some = store.read().filter("session_id < 'session 040'").select("event_id", "event_type")
    allowed = {r["event_id"] for r in some.collect()}
    same(rows_of(index.best(["w0", "w9"], 25, some, "all").pool), plain(texts, ["w0", "w9"], 25, allowed=allowed))
    assert index.best([], 5).pool.count() == 0 and index.best(["nowhere"], 5).pool.count() == 0


def test_topical_texts_leave_most_blocks_unread(spark):
    rng = random.Random(6)
    topics = [[f"t{k}x{j}" for j in range(8)] for k in range(30)]
    texts = {f"{i:06d}": " ".join(rng.choices(topics[rng.randrange(30)] + ["the", "of"] * 4, k=rng.choice([30, 60]))) for i in range(5000)}
    store = Snapshots(spark, shared_folder(spark, "store"))
    store.publish(replace=events(spark, texts, 1))
    index = SegmentedIndex.update(store)
    read = blocks = 0
    for k in range(3):
        terms = ["the", *(f"t{k}x{j}" for j in range(4))]
        found = index.best(terms, 20)
        same(rows_of(found.pool), plain(texts, terms, 20))
        read, blocks = read + found.blocks_read, blocks + found.blocks
    assert read < 0.5 * blocks


def test_pools_grow_until_they_settle_the_window(spark, large):
    store, index, texts = large
    rows = store.read().select("event_id", "session_id", "root_session_id", "event_type", "agent_scope", "occurred_at_ms", "event_sequence")
    show = lambda pool, n: [(r["session_id"], r["event_id"]) for r in shaping.result_window(shaping.diversified(shaping.session_champions(pool)), n).orderBy("shown").collect()]
    everything = index.best(["w1", "w2"], 6000, rows).pool
    for limit in (3, 60, 96):
        found = adaptive.candidates(index, ["w1", "w2"], limit, rows, None, tiers=False)
        assert show(found.pool, limit) == show(everything, limit)
        assert found.sizes[0] == max(256, 8 * limit) and not found.truncated
        assert all(b == 2 * a for a, b in zip(found.sizes, found.sizes[1:], strict=False))
    assert adaptive.candidates(index, ["w1", "w2"], 3, rows, None, tiers=False).pool.count() == 256
    short = adaptive.candidates(index, ["w1"], 97, rows, None, most=300, tiers=False)  # more sessions than there are
    assert short.truncated and short.sizes == [300]


def test_what_settles_a_window(spark):
    pool = lambda *rows: spark.createDataFrame(rows, "session_id string, root_session_id string, agent_scope string, score double")
    above = [("a", None, "primary", 9.0), ("b", None, "primary", 8.0), ("c", None, "primary", 1.0)]
    assert adaptive.decisive(pool(*above), 2, True)
    assert not adaptive.decisive(pool(*above), 3, True)  # no session is left over
    assert not adaptive.decisive(pool(*above[:2], ("c", None, "primary", 8.0)), 2, True)  # another may score as much as the second
    agents = [("a", "r", "subagent", 9.0), ("b", None, "primary", 8.9), ("c", None, "primary", 8.6)]
    assert not adaptive.decisive(pool(*agents), 1, True)  # a primary session of the root at 8.55 may be beyond
    assert adaptive.decisive(pool(*agents, ("d", None, "primary", 8.5)), 1, True)
    assert adaptive.decisive(pool(*above), 2, False) and not adaptive.decisive(pool(*above), 3, False)


def test_history_reads_bodies_of_shown_events_only(spark, large):
    store, index, texts = large
    found = History.open(store, indexed=True).search(["w5 w100"], limit=5, by_session=False).collect()
    want = plain(texts, ["w100", "w5"], 256, tiers=True)
    best = sorted(want, key=lambda x: (-round(x[2], 9), -int(x[0])))[:5]
    assert [r["event_id"] for r in found] == [i for i, _, _ in best]
    assert all(texts[r["event_id"]].startswith(r["snippet"][:10]) or r["truncated"] for r in found)
    whole = History(spark, store.read()).search(["w5 w100"], limit=5, by_session=False).collect()
    assert [r["event_id"] for r in whole][:1] == [found[0]["event_id"]]
