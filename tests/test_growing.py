"""Streams over growing files lose nothing; routes of a publication stand or fall alone."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from eventloom.queries.ingest import shared_folder
from eventloom.snapshots import LostClaim, Snapshots
from eventloom.sources import frontiers, jsonl, providers
from eventloom.streaming import growing

FORMAT = "pi_session_jsonl"


def line(text, session="s", **more):
    return json.dumps({"type": "message", "sessionId": session, "message": {"role": "user", "content": text}, **more}).encode() + b"\n"


def parse(records):
    return providers.project_format(records, FORMAT)


@pytest.fixture()
def store(spark):
    return Snapshots(spark, shared_folder(spark, "store"))


def refresh(store, folder, mark, **options):
    growing.refresh(store, str(folder), parse, mark, source_key=providers.source_key(FORMAT), **options).awaitTermination()


def bodies(store):
    return sorted(r["body"] for r in store.read().select("body").collect())


def batch_ids(spark, folder):
    return sorted(r["event_id"] for r in parse(jsonl.read_records(spark, str(folder))).select("event_id").collect())


def ids(store):
    return sorted(r["event_id"] for r in store.read().select("event_id").collect())


def of(verdicts, column="verdict"):
    return {r["source_key"].rsplit("/", 1)[-1]: r[column] for r in verdicts.collect()}


def test_grown_rewritten_and_unfinished_files(spark, store, tmp_path):
    mark = shared_folder(spark, "mark")
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_bytes(line("a1") + line("a2")[:-5])  # the second line isn't done
    b.write_bytes(line("b1"))
    refresh(store, tmp_path, mark)
    assert bodies(store) == ["a1", "b1"] and of(store.verdicts()) == {"a.jsonl": "created", "b.jsonl": "created"}
    a.write_bytes(line("a1") + line("a2") + line("a3"))
    refresh(store, tmp_path, mark)
    assert bodies(store) == ["a1", "a2", "a3", "b1"]
    assert of(store.verdicts()) == {"a.jsonl": "appended", "b.jsonl": "carried"} and of(store.verdicts(), "added")["a.jsonl"] == 2
    b.write_bytes(line("B!") + line("b2"))  # another beginning, and longer
    refresh(store, tmp_path, mark)
    assert bodies(store) == ["B!", "a1", "a2", "a3", "b2"] and of(store.verdicts())["b.jsonl"] == "replaced"
    assert ids(store) == batch_ids(spark, tmp_path)
    b.write_bytes(line("B!"))  # shorter
    refresh(store, tmp_path, mark)
    assert bodies(store) == ["B!", "a1", "a2", "a3"] and ids(store) == batch_ids(spark, tmp_path)
    before = store.active()
    os.utime(a, (1, 1))  # touched, nothing new
    refresh(store, tmp_path, mark)
    assert store.active() == before


def test_two_streams_and_a_new_checkpoint(spark, store, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    for folder in (one, two):
        folder.mkdir()
        (folder / "x.jsonl").write_bytes(line(f"{folder.name} 1") + line(f"{folder.name} 2"))
    refresh(store, one, shared_folder(spark, "mark"))
    refresh(store, two, shared_folder(spark, "mark"))  # a second stream into the same store
    assert bodies(store) == ["one 1", "one 2", "two 1", "two 2"]
    store.publish(notes={"by": "someone else"})
    (one / "x.jsonl").write_bytes((one / "x.jsonl").read_bytes() + line("one 3"))
    refresh(store, one, shared_folder(spark, "mark"))  # its checkpoint was lost
    assert bodies(store) == ["one 1", "one 2", "one 3", "two 1", "two 2"]
    assert of(store.verdicts(), "added")["x.jsonl"] in (0, 1) and len(set(ids(store))) == 5


def test_a_batch_that_is_run_again_adds_nothing(spark, store, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(line("a"))
    files = frontiers.listed(spark, str(tmp_path))
    run = lambda: growing.refresh_files(store, files, str(tmp_path), parse, providers.source_key(FORMAT))
    assert of(run()) == {"a.jsonl": "created"}
    assert run() is None and bodies(store) == ["a"]


def test_records_of_one_call_and_failing_sources(spark, store, tmp_path):
    """Updates of one call are events of their own; a file with a repeated id waits, the others go on."""
    update = lambda text: json.dumps({"params": {"sessionId": "g", "update": {"sessionUpdate": "tool_call_update", "toolCallId": "t1", "content": text}}}).encode() + b"\n"
    grok = tmp_path / "grok"
    grok.mkdir()
    (grok / "g.jsonl").write_bytes(update("one") + update("two") + update("three"))
    records = jsonl.read_records(spark, str(grok))
    store.publish(replace=providers.project_format(records, "grok_build_session_updates_jsonl"))
    assert bodies(store) == ["one", "three", "two"] and len(set(ids(store))) == 3
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "good.jsonl").write_bytes(line("g1", "g"))
    (mixed / "bad.jsonl").write_bytes(line("x1", id="same") + line("x2", id="same"))
    mark = shared_folder(spark, "mark")
    refresh(store, mixed, mark)
    assert of(store.verdicts()) == {"good.jsonl": "created", "bad.jsonl": "failed", "g.jsonl": "carried"}
    assert of(store.verdicts(), "reason")["bad.jsonl"].startswith("repeated id")
    assert bodies(store) == ["g1", "one", "three", "two"]
    (mixed / "bad.jsonl").write_bytes(line("x1", id="same") + line("x2", id="other"))
    refresh(store, mixed, mark)
    assert of(store.verdicts())["bad.jsonl"] == "created"
    (mixed / "bad.jsonl").write_bytes(line("x1", id="same") + line("x2", id="other") + line("x3", id="same"))
    refresh(store, mixed, mark)  # an appended line repeats an id that is there: rows and frontier stay
    assert store.read().filter("body LIKE 'x%'").count() == 2
    (mixed / "copy.jsonl").write_bytes(line("y", id="new"))
    (mixed / "dup.jsonl").write_bytes(line("y", id="new"))
    refresh(store, mixed, mark)  # one id in two sources: the first by name has it
    assert {k: v for k, v in of(store.verdicts()).items() if k in ("copy.jsonl", "dup.jsonl")} == {"copy.jsonl": "created", "dup.jsonl": "failed"}


def test_checks_and_moved_frontiers(spark, store, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(line("fine"))
    (tmp_path / "b.jsonl").write_bytes(line("much too long a text"))
    files = frontiers.listed(spark, str(tmp_path))
    found = growing.refresh_files(store, files, str(tmp_path), parse, providers.source_key(FORMAT), {"long body": F.length("body") < 10})
    assert of(found, "reason") == {"a.jsonl": None, "b.jsonl": "long body"}
    key = next(iter(store.generation().sources))
    state = store.generation().sources[key]
    row = (key, "append", 99, "h", state.frontier, "another hash")
    routes = spark.createDataFrame([row], "source_key string, change string, frontier long, prefix_hash string, known_frontier long, known_hash string")
    before = store.active()
    made, verdicts = store.publish_routes(store.read().limit(0), routes)
    assert made is None and store.active() == before and of(verdicts, "reason") == {"a.jsonl": "frontier moved"}


def test_session_lines_at_the_head_of_appended_files(spark, store, tmp_path):
    head = {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "c1"}}
    said = lambda t: {"type": "response_item", "timestamp": "2024-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": t}]}}
    dump = lambda *rows: b"".join(json.dumps(r).encode() + b"\n" for r in rows)
    codex = lambda records: providers.project_format(records, "codex_session_jsonl")
    file = tmp_path / "c.jsonl"
    for rows in ((head, said("one")), (head, said("one"), said("two"))):
        file.write_bytes(dump(*rows))
        growing.refresh_files(store, frontiers.listed(spark, str(tmp_path)), str(tmp_path), codex, providers.source_key("codex_session_jsonl"), context_bytes=4096)
    assert bodies(store) == ["one", "two"] and of(store.verdicts())["c.jsonl"] == "appended"
    assert {r["provider_session_id"] for r in store.read().collect()} == {"c1"}
    assert ids(store) == sorted(r["event_id"] for r in codex(jsonl.read_records(spark, str(tmp_path))).collect())


def test_reconcile_finds_what_no_stream_saw_and_counts_absences(spark, store, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_bytes(line(name))
    run = lambda: growing.reconcile(store, str(tmp_path), parse, source_key=providers.source_key(FORMAT))
    run()
    (tmp_path / "b.jsonl").unlink()
    (tmp_path / "c.jsonl").write_bytes(line("c"))
    run()
    assert bodies(store) == ["a", "b", "c"]
    run()
    assert bodies(store) == ["a", "b", "c"]
    run()  # absent for the third time
    assert bodies(store) == ["a", "c"]


def plain_facts(data):
    end = data.rfind(b"\n") + 1
    return end, data[:end]


def test_certificates_of_ranges(spark, tmp_path):
    rng = random.Random(3)
    data = {}
    for i in range(12):
        text = b"".join(bytes(rng.choices(b"abc", k=rng.randrange(0, 90))) + b"\n" for _ in range(rng.randrange(0, 40)))
        data[f"{i}.jsonl"] = text + b"tail" * (i % 3)
        (tmp_path / f"{i}.jsonl").write_bytes(data[f"{i}.jsonl"])
    none = "file string, size long, frontier long, prefix_hash string"
    start = spark.createDataFrame([(str(tmp_path / n), len(d), None, None) for n, d in data.items()], none)
    first = {r["file"]: r for r in frontiers.certified(start, str(tmp_path), 100).collect()}
    for n, d in data.items():
        r = first[str(tmp_path / n)]
        end, prefix = plain_facts(d)
        assert (r["frontier"], r["change"]) == (end, "cold")
        pieces = "".join(hashlib.sha256(prefix[i : i + 100]).hexdigest() for i in range(0, len(prefix), 100))
        assert r["prefix_hash"] == (hashlib.sha256(pieces.encode()).hexdigest() if prefix else frontiers.EMPTY_HASH)
    expected = {}
    for i, (n, d) in enumerate(data.items()):
        end, prefix = plain_facts(d)
        new, expected[n] = [(d, "unchanged"), (prefix + b"more\nand more\n", "append"), (b"?" + prefix[1:] + b"x\n", "replace" if prefix else "append"), (prefix[:-2], "replace" if prefix else "unchanged")][i % 4]
        (tmp_path / n).write_bytes(new)
    again = spark.createDataFrame([(f, os.path.getsize(f), r["frontier"], r["prefix_hash"]) for f, r in first.items()], none)
    found = {r["file"].rsplit("/", 1)[-1]: r["change"] for r in frontiers.certified(again, str(tmp_path), 100).collect()}
    assert found == expected
    spans = spark.createDataFrame([(str(tmp_path / "1.jsonl"), 0, os.path.getsize(tmp_path / "1.jsonl"))], "file string, floor long, stop long")
    whole = (tmp_path / "1.jsonl").read_bytes()
    got = [(r["offset"], r["value"].encode()) for r in frontiers.lines(spans, str(tmp_path), line_range=64).orderBy("offset").collect()]
    assert b"".join(v + b"\n" for _, v in got) == whole.replace(b"\n\n", b"\n").lstrip(b"\n") or all(whole[o : o + len(v)] == v for o, v in got)


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: only its last lines are data; its bytes are hashed range by range."""
    file = tmp_path / "large.jsonl"
    size = (2 << 30) + 4096
    with file.open("wb") as out:
        out.truncate(size)
        out.seek(size)
        out.write(b"\n" + line("end"))
    listed = frontiers.listed(spark, str(tmp_path)).withColumns({"frontier": F.lit(None).cast("long"), "prefix_hash": F.lit(None).cast("string")})
    seen = frontiers.certified(listed, str(tmp_path), 64 << 20).first()
    assert (seen["frontier"], seen["change"]) == (file.stat().st_size, "cold")
    spans = spark.createDataFrame([(str(file), size + 1, seen["frontier"])], "file string, floor long, stop long")
    assert [r["offset"] for r in frontiers.lines(spans, str(tmp_path)).collect()] == [size + 1]


def test_an_overtaken_publisher_moves_nothing(spark, store):
    rows = [("k", "e1", "s", 1, "message")]
    events = spark.createDataFrame(rows, "source_key string, event_id string, session_id string, event_sequence long, event_type string")
    first = store.publish(replace=events)
    kept = store._keep_claim

    def overtaken(base, claimant):
        kept(base, claimant)
        store._write(f"claims/{base}.json", json.dumps({"by": "another", "ms": 0}))

    store._keep_claim = overtaken
    with pytest.raises(LostClaim):
        store.publish(notes={"x": "y"})
    assert store.active() == first


def test_rules_of_dialects(spark):
    """What a record holds decides its type before its kind does."""
    cases = {
        "tabnine_cli_chat_recording_jsonl": [
            ({"type": "user", "content": "hi"}, ("message", "user", "hi")),
            ({"type": "gemini", "content": "yes"}, ("message", "assistant", "yes")),
            ({"type": "tabnine", "toolCalls": [{"name": "grep"}], "content": "looking"}, ("tool_call", "assistant", "looking")),
            ({"type": "tabnine", "toolCalls": [{"name": "grep", "result": "x"}], "content": "found"}, ("tool_output", "assistant", "found")),
            ({"$rewindTo": "m7"}, ("notice", "system", "rewind to m7")),
            ({"type": "info", "content": "note"}, ("notice", "system", "note")),
        ],
        "antigravity_cli_transcript_jsonl_tree": [
            ({"type": "USER_INPUT", "content": "do"}, ("message", "user", "do")),
            ({"type": "PLANNER_RESPONSE", "content": "plan", "tool_calls": [{"name": "run"}]}, ("tool_call", "assistant", "plan")),
            ({"type": "CHECKPOINT", "content": "so far"}, ("summary", "system", "so far")),
            ({"type": "ELSE", "source": "executor", "content": "ran"}, ("notice", "tool", "ran")),
            ({"type": "PLANNER_RESPONSE", "thinking": "hm"}, ("message", "assistant", "hm")),
        ],
        "copilot_cli_session_events_jsonl": [
            ({"type": "session.truncation", "data": {"content": "cut"}}, ("summary", "system", "cut")),
            ({"type": "tool.execution_start", "data": {"arguments": "ls"}}, ("tool_call", "tool", "ls")),
            ({"type": "new.kind", "data": {"content": "x"}}, ("notice", "system", "x")),
        ],
        "qwen_code_chat_jsonl": [
            ({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "go"}, {"type": "tool_use", "name": "ls"}]}}, ("tool_call", "assistant", None)),
            ({"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "go"}]}}, ("message", "user", "go")),
            ({"type": "tool_result", "message": {"content": "done"}}, ("tool_output", "tool", "done")),
        ],
    }
    for name, rows in cases.items():
        records = spark.createDataFrame([("f", i, json.dumps(r)) for i, (r, _) in enumerate(rows)], "file string, offset long, value string")
        got = {r["event_sequence"] // 64: (r["event_type"], r["role"], r["body"]) for r in providers.project_format(records, name).collect()}
        for i, (_, want) in enumerate(rows):
            assert got[i][:2] == want[:2] and want[2] in (None, got[i][2]), (name, i, got.get(i))


def test_tables_joined_inside_databases(spark, tmp_path):
    import sqlite3

    from eventloom.sources.sqlite import Joined, SqliteJoinReader, read_joined

    for n in range(3):
        link = sqlite3.connect(tmp_path / f"{n}.db")
        link.execute("CREATE TABLE a (k INTEGER, v TEXT)")
        link.executemany("INSERT INTO a VALUES (?, ?)", [(1, f"one {n}"), (2, "two"), (3, None)])
        if n < 2:
            link.execute("CREATE TABLE b (k INTEGER, w TEXT)")
            link.executemany("INSERT INTO b VALUES (?, ?)", [(1, "x"), (1, "y"), (3, "z")])
        link.commit()
        link.close()
    joined = lambda required: read_joined(spark, str(tmp_path), "a", {"key": "k", "value": "v", "missing": "nothing"}, [Joined("b", (("k", "k"),), {"other": "w"}, required)])
    rows = lambda df: sorted((r["database"][-4], r["key"], r["value"] or "", r["other"] or "", r["missing"]) for r in df.collect())
    both = [(d, k, v.format(d), w, None) for d in "01" for k, v, w in (("1", "one {}", "x"), ("1", "one {}", "y"), ("3", "", "z"))]
    assert rows(joined(True)) == sorted(both)
    outer = [(d, "2", "two", "", None) for d in "012"] + [("2", "1", "one 2", "", None), ("2", "3", "", "", None)]
    assert rows(joined(False)) == sorted(both + outer)
    some = joined(False).filter("key = '1' AND other > 'x' AND value LIKE 'one%'")
    assert rows(some) == [(d, "1", f"one {d}", "y", None) for d in "01"]
    reader = SqliteJoinReader({"path": str(tmp_path), "base": "a", "columns": '{"key": "k"}', "joins": "[]"})
    from pyspark.sql.datasource import EqualTo, IsNull

    assert list(reader.pushFilters([EqualTo(("key",), "2"), IsNull(("key",)), EqualTo(("database",), "x")])) == [IsNull(("key",)), EqualTo(("database",), "x")]
    assert reader.statement({"a": {"k"}}) is not None and reader.statement({}) is None and reader.pushed == [("key", "=", "2")]
