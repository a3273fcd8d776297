import json
import sqlite3
import uuid

import pytest
from pyspark.sql import functions as F

from eventloom.plans.history import History, documents_to_embed, import_records
from eventloom.operators.filters import EventFilters
from eventloom.queries.ingest import CLAUDE, CODEX, _lines, shared_folder
from eventloom.queries.literals import events_fixture
from eventloom.snapshots import Snapshots
from eventloom.sources import custom_history, jsonl, providers, sqlite
from eventloom.streaming import refresh


def test_bounded_jsonl(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    lines = [json.dumps({"i": i, "pad": "x" * (i % 50)}) for i in range(500)]
    file = folder / "a.jsonl"
    file.write_bytes(("\n".join(lines) + "\n").encode() + b'{"half": ')
    got = jsonl.read_records(spark, str(tmp_path / "in"), rangeBytes=1000).orderBy("offset").collect()
    assert [r["value"] for r in got] == lines
    frontier = got[300]["offset"]
    rest = jsonl.read_records(spark, str(tmp_path / "in"), {got[0]["file"]: frontier}, rangeBytes=777).orderBy("offset").collect()
    assert [r["value"] for r in rest] == lines[300:]
    large = jsonl.read_records(spark, str(tmp_path / "in"), maxBytes=40)
    assert 0 < jsonl.split_oversized(large).count() < 500
    with pytest.raises(Exception, match="oversized"):
        jsonl.split_oversized(large, "reject_source").select("value").collect()
    (folder / "b.jsonl").write_bytes(b'{"i":1}\n{"i":2}\0\0\0\n')
    assert sorted(r["value"] for r in jsonl.read_records(spark, str(folder / "b.jsonl")).collect()) == ['{"i":1}', '{"i":2}']
    import zstandard

    (folder / "c.jsonl.zst").write_bytes(zstandard.compress(b'{"z":1}\n{"z":2}\n'))
    assert jsonl.read_records(spark, str(folder / "c.jsonl.zst")).count() == 2


def test_source_changes(spark, tmp_path):
    for name, body in (("same", "a\nb\n"), ("grown", "a\n"), ("rewritten", "a\nb\n"), ("gone", "a\n")):
        (tmp_path / name).write_text(body)
    known = jsonl.frontier_of(jsonl.listing(spark, str(tmp_path))).collect()
    (tmp_path / "grown").write_text("a\nb\n")
    (tmp_path / "rewritten").write_text("x\nb\n")
    (tmp_path / "gone").unlink()
    (tmp_path / "new").write_text("q\n")
    found = jsonl.classify(jsonl.listing(spark, str(tmp_path)), spark.createDataFrame(known))
    assert {r["path"].rsplit("/", 1)[-1]: r["change"] for r in found.collect()} == {"same": "unchanged", "grown": "append", "rewritten": "replace", "gone": "removed", "new": "cold"}


def test_sqlite_tables(spark, tmp_path):
    for n in range(2):
        link = sqlite3.connect(tmp_path / f"{n}.db")
        link.execute("CREATE TABLE message (id TEXT, session_id TEXT, role TEXT, data TEXT, created_at INTEGER)")
        link.execute("INSERT INTO message VALUES (?, 's', 'user', ?, 1709288430)", (f"m{n}", json.dumps({"parts": [{"type": "text", "text": "hi \"there\""}]})))
        link.commit()
        link.close()
    dialect = providers.DIALECTS["opencode_sqlite"]
    rows = sqlite.read_table(spark, str(tmp_path), dialect.table, list(dialect.columns))
    events = providers.project(providers.sqlite_records(rows), dialect).collect()
    assert len(events) == 2 and {e["native_event_id"] for e in events} == {"m0", "m1"}
    assert all(e["body"] == 'hi "there"' and e["occurred_at_ms"] == 1709288430000 and e["role"] == "user" for e in events)
    assert sqlite.schema_fingerprint(str(tmp_path / "0.db")) == sqlite.schema_fingerprint(str(tmp_path / "1.db"))


@pytest.mark.parametrize("name", sorted(providers.DIALECTS))
def test_every_dialect_reads_a_plain_record(spark, name):
    d = providers.DIALECTS[name]

    def put(node, path, value):
        *front, last = path.split(".")
        for p in front:
            node = node.setdefault(p, {})
        node[last] = value

    record = {}
    put(record, d.session[0], "s-1")
    put(record, d.time[0], "2024-01-01T00:00:00Z")
    put(record, d.content[0], "some text")
    if d.kinds:
        put(record, d.kind[0], next(iter(d.kinds)))
    event = providers.project_format(_lines(spark, [record]), name).collect()
    assert len(event) == 1
    assert (event[0]["body"], event[0]["provider_session_id"], event[0]["occurred_at_ms"], event[0]["provider"]) == ("some text", "s-1", 1704067200000, d.provider)
    if d.kinds:
        assert event[0]["event_type"] == next(iter(d.kinds.values()))[0]


def test_json_documents(spark):
    files = spark.createDataFrame([("f", b'{"messages": [{"id": "a", "content": "x"}, {"id": "b", "content": "y"}]}')], "path string, content binary")
    events = providers.project_format(providers.document_records(files, "messages"), "codebuddy_history_json")
    assert sorted((r["native_event_id"], r["body"]) for r in events.collect()) == [("a", "x"), ("b", "y")]


def test_custom_history_needs_one_manifest(spark):
    with pytest.raises(ValueError, match="missing"):
        custom_history.load(_lines(spark, [{"record_type": "source"}]))
    with pytest.raises(ValueError, match="more than one"):
        custom_history.load(_lines(spark, [{"record_type": "manifest"}] * 2))


def test_snapshots(spark):
    store = Snapshots(spark, shared_folder(spark, "store"))
    events = events_fixture(spark).withColumn("source_key", F.concat(F.lit("k"), F.col("provider")))
    first = store.publish(replace=events)
    assert store.read().count() == 16 and store.duplicates().count() == 0
    assert store.read(sources=["kclaude"]).count() == 4
    second = store.republish({"why": "test"})
    assert store.pointer() == {"active": second, "previous": first}
    with pytest.raises(RuntimeError):
        store.publish(delete=["kclaude"], expected=first)
    for n in range(3):
        store.publish(absent=["kcustom"])
        assert ("kcustom" in store.generation().sources) == (n < 2)
    with pytest.raises(ValueError):
        store.publish(append=events.filter("provider = 'custom'"))
    store.lease(first, "reader")
    store.publish(replace=events.filter("provider = 'claude'").limit(1))
    store.publish(notes={"x": "y"})
    store.reclaim()
    assert store.read(first).count() == 16
    store.release("reader")
    store.reclaim()
    with pytest.raises(ValueError):
        store.generation(first)
    assert store.read().groupBy("source_key").count().count() == 2
    for _ in range(2):
        store.publish(replace=events)
    assert store.reclaim() and store.read().count() == 16


def test_history(spark):
    store = Snapshots(spark, shared_folder(spark, "store"))
    store.publish(replace=events_fixture(spark).withColumn("source_key", F.lit("k")))
    history = History.open(store)
    found = history.search(["parser lexer"], limit=3).collect()
    assert [r["shown"] for r in found] == [1, 2, 3] and found[0]["more_available"]
    for _ in range(2):  # the index is made, then found
        by_index = History.open(store, indexed=True).search(["parser lexer"], limit=3).collect()
        assert [(r["event_id"], round(r["score"], 9)) for r in by_index] == [(r["event_id"], round(r["score"], 9)) for r in found]
    assert {r["session_id"] for r in history.search(["parser"], active_session="s2").collect()}.isdisjoint({"s1", "s2", "s3"})
    only = history.search([""], EventFilters(file="lexer"), by_session=False).collect()
    assert len(only) == 2 and [r["event_id"][:16] for r in only] == ["0000000000000002", "0000000000000001"]
    page = history.list_events(limit=5)
    rest = history.list_events(limit=100, cursor=history.next_cursor(page))
    ids = [r["event_id"] for r in page.collect()] + [r["event_id"] for r in rest.collect()]
    assert len(ids) == 16 and len(set(ids)) == 16
    shown = history.show_event("0000000000000003", 1, 1)
    assert sorted(r["distance"] for r in shown["window"].collect()) == [-1, 0, 1]
    assert [r["event_sequence"] for r in history.show_session("s1", "lite", 9).collect()] == [0, 4, 5]
    assert history.status().first()["documents"] == 16
    with pytest.raises(ValueError):
        history.search(["x"], backend="semantic")
    vectors = spark.createDataFrame([("0000000000000007aaaabbbbccccdddd", 0, "h", [1.0, 0.0]), ("000000000000000baaaabbbbccccdddd", 0, "h", [0.6, 0.8])], "event_id string, chunk_index int, source_text_hash string, embedding array<float>")
    both = History(spark, store.read(), "g", vectors).search(["parser"], backend="hybrid", query_vector=[1.0, 0.0]).collect()
    assert both[0]["score"] > 0
    near = History(spark, store.read(), "g", vectors).search([], backend="semantic", query_vector=[1.0, 0.0]).collect()
    assert near[0]["event_id"].startswith("0000000000000007")


def test_embedding_documents(spark):
    docs = documents_to_embed(events_fixture(spark)).collect()
    first = next(r for r in docs if r["event_id"].startswith("0000000000000001"))
    assert first["text"].startswith("passage: semantic_document: v3\nevent_type: message\nrole: user") and "assistant:\nthe parser is fixed" in first["text"]
    known = spark.createDataFrame([(first["event_id"], first["source_text_hash"])], "event_id string, source_text_hash string")
    assert len(documents_to_embed(events_fixture(spark), known).collect()) == len(docs) - 1


def test_import_and_refresh(spark):
    store = Snapshots(spark, shared_folder(spark, "store"))
    import_records(store, _lines(spark, CODEX), "codex_session_jsonl")
    import_records(store, _lines(spark, CLAUDE), "claude_projects_jsonl_tree")
    assert store.read().groupBy("provider").count().count() == 2
    assert len(providers.FORMATS) >= 40
    with pytest.raises(ValueError):
        providers.project_format(_lines(spark, CODEX), "unheard_of")


def test_identities_and_publishers(spark):
    record = json.dumps({"type": "message", "sessionId": "s", "message": {"role": "user", "content": "hi"}})
    with_id = json.dumps({"type": "message", "id": "m1", "sessionId": "s", "message": {"role": "user", "content": "hi"}})
    rows = [("a", 0, record), ("a", 90, record), ("b", 0, record), ("a", 200, with_id), ("b", 300, with_id)]
    events = providers.project_format(spark.createDataFrame(rows, "file string, offset long, value string"), "pi_session_jsonl")
    ids = [r["event_id"] for r in events.orderBy("source_key", "event_sequence").collect()]
    assert len(set(ids)) == 4 and ids[2] == ids[4]  # known by its own id, wherever it stands
    store = Snapshots(spark, shared_folder(spark, "store"))
    with pytest.raises(ValueError, match="same id"):
        store.publish(replace=events)
    assert store.active() is None
    first = store.publish(replace=events.filter("source_key LIKE '%a'"))
    with pytest.raises(ValueError, match="same id"):
        store.publish(append=events.filter("source_key LIKE '%a'"))
    assert store.active() == first
    store._claim(first, "someone else")  # another publisher that came first
    with pytest.raises(RuntimeError, match="in between"):
        store.publish(notes={"x": "y"})
    assert store.active() == first and store.read().count() == 3


def test_dirty_ledger(spark):
    folder = shared_folder(spark, "deliveries")
    rows = [("r", 1, 1, 1000), ("r", 1, 1, 1200), ("r", 1, 2, 1100), ("r", 0, 9, 9000), ("q", 1, 5, 50)]
    frame = spark.createDataFrame(rows, "route string, epoch long, sequence long, at_ms long")
    frame.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    name = f"ledger_{uuid.uuid4().hex}"
    refresh.dirty_ledger(stream).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", shared_folder(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    got = {r["route"]: (r["epoch"], r["sequence"], r["due_ms"]) for r in spark.table(name).collect()}
    assert got == {"r": (1, 2, 1350), "q": (1, 5, 300)}


def test_new_deliveries_and_retries(spark):
    frame = spark.createDataFrame([("r", 1, 1), ("r", 1, 1), ("r", 2, 1)], "route string, epoch long, sequence long")
    assert refresh.new_deliveries(frame).count() == 2
    tries = spark.createDataFrame([("a", 1, "failure"), ("a", 5, "success"), ("a", 10, "failure"), ("a", 20, "failure"), ("b", 1, "permanent"), ("c", 1, "success")], "route string, at_ms long, outcome string")
    got = {r["route"]: (r["failures"], r["blocked"], r["not_before_ms"]) for r in refresh.retry_state(tries).collect()}
    assert got == {"a": (2, False, 2020), "b": (1, True, None)}
