"""Reading histories, publishing snapshots and refreshing by stream."""

from __future__ import annotations

import json
import re
import sqlite3
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import content_leaf, leaf_sum
from ..operators import counts, reconcile
from ..schema import EVENT_TYPES, conform
from ..snapshots import Snapshots
from ..sources import custom_history, jsonl, providers
from ..streaming import growing, refresh
from .tables import TRANSCRIPT_SQL, table, transcript_events


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, records: list) -> DataFrame:
    rows = [("f", i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "file string, offset long, value string")


CUSTOM = [
    {"record_type": "manifest", "schema_version": "1", "lineage_contract": "1"},
    {"record_type": "source", "source_id": "a", "provider_key": "acme"},
    {"record_type": "session", "source_id": "a", "session_id": "s1", "native_session_id": "n1"},
    {"record_type": "session", "source_id": "a", "session_id": "s2", "native_session_id": "n2"},
    {"record_type": "session", "source_id": "a", "session_id": "s2", "native_session_id": "n2"},
    {"record_type": "session", "source_id": "b", "session_id": "s3"},
    {"record_type": "session", "source_id": "a", "session_id": "s4", "parent_session_id": "s4"},
    {"record_type": "edge", "source_id": "a", "from_session_id": "s1", "to_session_id": "s2", "relationship": "forked"},
    {"record_type": "edge", "source_id": "a", "from_session_id": "s9", "to_session_id": "s2", "relationship": "forked"},
    {"record_type": "event", "source_id": "a", "session_id": "s1", "event_index": 0, "event_id": "e0", "event_type": "message", "role": "user", "occurred_at": "2024-01-01T00:00:00Z", "payload": {"text": "hello"}},
    {"record_type": "event", "source_id": "a", "session_id": "s1", "event_index": 1, "event_id": "e1", "event_type": "message", "role": "assistant", "occurred_at": "2024-01-01T00:00:01Z", "payload": {"content": "hi there"}},
    {"record_type": "event", "source_id": "a", "session_id": "s2", "event_index": 0, "event_id": "e0", "event_type": "message", "role": "user", "occurred_at": "2024-01-01T00:00:02Z", "payload": {"text": "hello"}, "copied_from": {"ancestor_native_session_id": "n1", "ancestor_event_id": "e0", "proof": "native_event_identity"}},
    {"record_type": "event", "source_id": "a", "session_id": "s2", "event_index": 1, "event_id": "e5", "event_type": "notice", "occurred_at": "bad", "payload": {}, "copied_from": {"ancestor_native_session_id": "n1", "ancestor_event_id": "e1", "proof": "native_event_identity"}},
    {"record_type": "event", "source_id": "a", "session_id": "s8", "event_index": 0, "event_type": "message", "payload": {"text": "lost"}},
    {"record_type": "file_reference", "source_id": "a", "session_id": "s1", "reference_index": 1, "event_index": 0, "value": "b.rs"},
    {"record_type": "file_reference", "source_id": "a", "session_id": "s1", "reference_index": 0, "event_index": 0, "value": "a.rs"},
    {"record_type": "file_reference", "source_id": "a", "session_id": "s1", "reference_index": 2, "value": "c.rs"},
    {"record_type": "file_reference", "source_id": "a", "session_id": "s1", "reference_index": 3, "event_index": 7, "value": "d.rs"},
    {"record_type": "surprise"},
    '{"record_type": "event", ',
]


def ingest_custom_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = custom_history.load(_lines(spark, CUSTOM))
    files = F.array_join(F.transform("facts", lambda f: f["value"]), ",")
    return events.select("custom_source_id", "provider_session_id", "event_sequence", "occurred_at_ms", "role", "body", "session_relationship", F.col("copy_ancestor_event_id").alias("copied_from"), files.alias("files"))


def ingest_custom_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = custom_history.load(_lines(spark, CUSTOM))
    return rejects.select("offset", "reason")


CODEX = [
    {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "c1", "cwd": "/w"}},
    {"type": "response_item", "timestamp": "2024-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "fix it"}]}},
    {"type": "response_item", "timestamp": "2024-01-01T00:00:02Z", "payload": {"type": "reasoning", "summary": [{"type": "summary_text", "text": "think"}]}},
    {"type": "response_item", "timestamp": "2024-01-01T00:00:02Z", "payload": {"type": "reasoning", "summary": [], "encrypted_content": "xx"}},
    {"type": "response_item", "timestamp": "2024-01-01T00:00:03Z", "payload": {"type": "function_call", "name": "shell", "arguments": '{"command":"ls","workdir":"/w"}', "call_id": "k1"}},
    {"type": "response_item", "timestamp": "2024-01-01T00:00:04Z", "payload": {"type": "function_call_output", "call_id": "k1", "output": "a.rs"}},
    {"type": "response_item", "timestamp": "2024-01-01T00:00:05Z", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": ""}]}},
    {"type": "event_msg", "timestamp": "2024-01-01T00:00:06Z", "payload": {"type": "token_count"}},
    {"type": "compacted", "timestamp": "2024-01-01T00:00:07Z", "payload": {"message": "so far"}},
]
CLAUDE = [
    {"type": "user", "uuid": "u1", "sessionId": "x", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}},
    {"type": "assistant", "uuid": "u2", "sessionId": "x", "timestamp": "2024-01-01T00:00:01Z", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "one"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "a.rs"}}, {"type": "text", "text": "two"}]}},
    {"type": "assistant", "uuid": "u3", "sessionId": "x", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}]}},
    {"type": "summary", "summary": "all of it", "sessionId": "x"},
    {"type": "file-history-snapshot", "sessionId": "x"},
]
GEMINI = [
    {"type": "user", "id": "g1", "sessionId": "g", "timestamp": "2024-01-01T00:00:00Z", "content": "question"},
    {"type": "gemini", "id": "g2", "sessionId": "g", "timestamp": "2024-01-01T00:00:01Z", "content": [{"text": "answer"}]},
    {"type": "$set", "id": "g3", "sessionId": "g"},
]


def ingest_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = providers.project_format(_lines(spark, CODEX), "codex_session_jsonl")
    return events.select((F.col("event_sequence") / 64).cast("long").alias("line"), "event_type", "role", "provider_session_id", "call_id", F.when(F.col("event_type") != "tool_call", F.col("body")).alias("body"), F.size("facts").cast("long").alias("n_facts"))


def ingest_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = providers.project_format(_lines(spark, CLAUDE), "claude_projects_jsonl_tree")
    return events.select("event_sequence", "event_type", "role", "tool", F.when(F.col("event_type") != "tool_call", F.col("body")).alias("body"), F.array_join(F.transform("facts", lambda f: F.concat(f["kind"], F.lit("="), f["value"])), ",").alias("facts"))


def ingest_gemini(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = providers.project_format(_lines(spark, GEMINI), "gemini_cli_chat_recording_jsonl")
    return events.select("native_event_id", "event_type", "role", "body", "occurred_at_ms")


def ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw source documents: a source row each, with the digest of its content."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = transcript_events(spark, sf_dir)
    return conform(events.withColumn("source_key", F.concat(F.lit("conv-"), (F.col("session_id") % 10).cast("string"))))


def snapshot_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold publication, replacement of one source, deletion of another; then read."""
    store = Snapshots(spark, shared_folder(spark, "snapshots"))
    events = _transcripts(spark, sf_dir)
    first = store.publish(replace=events)
    store.publish(replace=events.filter("source_key = 'conv-3'").filter("event_sequence < 2"), delete=["conv-4"], expected=first)
    return counts.source_totals(store.read()).select("source_key", "events", "sessions")


def snapshot_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in two parts have the content sums of the whole."""
    store = Snapshots(spark, shared_folder(spark, "snapshots"))
    events = _transcripts(spark, sf_dir)
    store.publish(replace=events.filter("event_sequence < 2"))
    store.publish(append=events.filter("event_sequence >= 2"))
    kept = spark.createDataFrame([(k, s.content_sum) for k, s in store.generation().sources.items()], "source_key string, content_sum string")
    whole = counts.content_sums(events).withColumnRenamed("content_sum", "expected")
    return kept.join(whole, "source_key").select("source_key", (F.col("content_sum") == F.col("expected")).alias("same"))


def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, stale, unchanged and gone sources between two states of the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("digest"))
    was = docs.filter("key % 10 <> 0").withColumn("digest", F.when(F.col("key") % 7 == 0, F.lit("old")).otherwise(F.col("digest")))
    return reconcile.reconcile(docs.filter("key % 11 <> 0"), was)


def content_sum_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free sum of leaves by source: equal to the one of the rows in any order."""
    docs = table(spark, sf_dir, "documents")
    leaf = content_leaf(F.col("doc_id").cast("string"), F.col("text"))
    there = docs.groupBy("source").agg(leaf_sum(leaf).alias("a"))
    back = docs.orderBy(F.col("doc_id").desc()).groupBy("source").agg(leaf_sum(leaf).alias("b"))
    return there.join(back, "source").select("source", (F.col("a") == F.col("b")).alias("same"))


def streamed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as text files, read as a stream and published batch by batch."""
    folder, root, mark = (shared_folder(spark, n) for n in ("incoming", "streamed", "stream-mark"))
    turns = table(spark, sf_dir, "conversations")
    turns.repartition(4, "conv_id").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")).write.text(folder)

    def parse(records: DataFrame) -> DataFrame:
        r = records.select("file", F.from_json("value", "conv_id long, turn long, role string, text string").alias("r"))
        return r.select(F.col("file").alias("source_key"), F.concat_ws("-", "r.conv_id", "r.turn").alias("event_id"), F.col("r.conv_id").cast("string").alias("session_id"), F.col("r.turn").alias("event_sequence"), F.lit("message").alias("event_type"), F.col("r.role").alias("role"), F.col("r.text").alias("body"))

    store = Snapshots(spark, root)
    growing.refresh(store, folder, parse, mark, suffixes=".txt").awaitTermination()
    return store.read().groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


def streamed_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a dialect without ids of their own: a stream gives them the ids of a batch import."""
    folder, root, mark = (shared_folder(spark, n) for n in ("incoming", "streamed", "stream-mark"))
    said = F.struct(F.col("role"), F.col("text").alias("content"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("s"), F.col("conv_id") % 100).alias("sessionId"), said.alias("message"))).alias("value"))
    lines.repartition(4).select("value").write.text(folder)  # sessions go across files
    parse = lambda records: providers.project_format(records, "pi_session_jsonl")
    store = Snapshots(spark, root)
    growing.refresh(store, folder, parse, mark, suffixes=".txt", source_key=providers.source_key("pi_session_jsonl")).awaitTermination()
    streamed = store.read().select("event_id", "role", "session_id")
    at_once = parse(jsonl.read_records(spark, folder, suffixes=".txt")).select(F.col("event_id").alias("batch_id"))
    both = streamed.join(at_once, F.col("event_id") == F.col("batch_id"), "full_outer")
    return both.groupBy("role").agg(F.count("event_id").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.count("batch_id").alias("n_batch"), F.countDistinct("session_id").alias("sessions"))


INSTALMENTS = 3
CONVERSATIONS_PER_FILE = 50


def _write_growing(turns: DataFrame, folder: str, instalment: int) -> None:
    """Every file with its first ``instalment`` parts: what an earlier call wrote, and more lines.

    A part holds the turns of one remainder, so conversations go on in later parts.
    """

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        fs, root = jsonl.open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/{key[0].as_py()}.jsonl"
        with fs.open_output_stream(name) as out:
            for line in rows.sort_by([("part", "ascending"), ("conv_id", "ascending"), ("turn", "ascending")])["line"].to_pylist():
                out.write(line.encode() + b"\n")
            out.write(b'{"an unfinished": ')
        return pa.table({"file": [name]})

    said = F.struct(F.col("role"), F.col("text").alias("content"))
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), said.alias("message")))
    parts = turns.select("conv_id", "turn", (F.col("turn") % INSTALMENTS).alias("part"), line.alias("line")).filter(F.col("part") < instalment)
    parts.groupBy(F.floor(F.col("conv_id") / CONVERSATIONS_PER_FILE).alias("file")).applyInArrow(write, "file string").collect()  # names of files


def streamed_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written in three instalments to the same files; each is streamed as appended lines.

    The end has the ids of one batch import, and no instalment but the first
    reads a source anew.
    """
    folder, root, mark = (shared_folder(spark, n) for n in ("growing", "grown", "growing-mark"))
    parse = lambda records: providers.project_format(records, "pi_session_jsonl")
    store = Snapshots(spark, root)
    turns = table(spark, sf_dir, "conversations")
    how = []
    for n in range(1, INSTALMENTS + 1):
        _write_growing(turns, folder, n)
        growing.refresh(store, folder, parse, mark, source_key=providers.source_key("pi_session_jsonl")).awaitTermination()
        how.append(store.verdicts().select(F.lit(n).alias("instalment"), "source_key", "verdict", "added"))
    appended = reduce(DataFrame.unionByName, how).groupBy("source_key").agg(F.sum(F.when(F.col("verdict") == "appended", F.col("added"))).alias("later"))
    streamed = store.read().select("source_key", "event_id", "role", F.length("body").alias("chars"))
    at_once = parse(jsonl.read_records(spark, folder)).select(F.col("event_id").alias("batch_id"))
    both = streamed.join(at_once, F.col("event_id") == F.col("batch_id"), "full_outer")
    name = F.regexp_extract("source_key", r"(\d+)\.jsonl$", 1).cast("long")
    return (
        both.groupBy("source_key")
        .agg(F.count("event_id").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.count("batch_id").alias("n_batch"), F.sum("chars").alias("chars"))
        .join(appended, "source_key", "left")
        .select(name.alias("file"), "n", "n_ids", "n_batch", "chars", F.coalesce("later", F.lit(0)).alias("n_appended"))
    )


def routes_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publication of all sources in which three fail: they keep their rows, the others go on."""
    store = Snapshots(spark, shared_folder(spark, "routes"))
    events = _transcripts(spark, sf_dir)
    first = events.select("source_key").distinct().select("source_key", F.lit("cold").alias("change"), F.lit(2).cast("long").alias("frontier"), F.lit("two").alias("prefix_hash"), F.lit(None).cast("long").alias("known_frontier"), F.lit(None).cast("string").alias("known_hash"))
    store.publish_routes(events.filter("event_sequence < 2"), first)
    again = F.col("source_key") == "conv-1"  # every id twice
    kind = F.when((F.col("source_key") == "conv-2"), "surprise").otherwise(F.col("event_type"))
    rest = events.filter("event_sequence >= 2").withColumn("event_type", kind)
    rest = rest.unionByName(rest.filter(again))
    moved = F.when(F.col("source_key") == "conv-3", "other").otherwise(F.lit("two"))
    routes = first.select("source_key", F.lit("append").alias("change"), F.lit(9).cast("long").alias("frontier"), F.lit("nine").alias("prefix_hash"), F.lit(2).cast("long").alias("known_frontier"), moved.alias("known_hash"))
    _, verdicts = store.publish_routes(rest, routes, {"unknown event type": F.col("event_type").isin(*EVENT_TYPES)})
    now = counts.source_totals(store.read()).select("source_key", F.col("events").alias("n"))
    return verdicts.join(now, "source_key", "left").select("source_key", "verdict", F.regexp_replace("reason", "^(repeated id).*", "$1").alias("reason"), F.coalesce("n", F.lit(0)).alias("n"))


def _write_agent_databases(turns: DataFrame, folder: str) -> None:
    """Conversations as databases of an agent, ``CONVERSATIONS_PER_FILE`` each: transcripts,
    events, identities (some missing, some twice) and sessions with parents."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        fs, root = jsonl.open_fs(folder)
        fs.create_dir(root, recursive=True)
        with tempfile.TemporaryDirectory() as here:
            link = sqlite3.connect(f"{here}/x.db")
            link.executescript(
                "CREATE TABLE session_transcript_active_events (session_id TEXT, active_position INTEGER, event_seq INTEGER); CREATE TABLE transcript_events (session_id TEXT, seq INTEGER, event_json TEXT, created_at INTEGER);"
                "CREATE TABLE transcript_event_identities (session_id TEXT, seq INTEGER, event_id TEXT); CREATE TABLE sessions (session_id TEXT, parent_session_id TEXT);"
            )
            for r in rows.sort_by([("conv_id", "ascending"), ("turn", "ascending")]).to_pylist():
                session, seq = f"s{r['conv_id']}", r["turn"] + 10
                if r["turn"] == 0:
                    link.execute("INSERT INTO sessions VALUES (?, ?)", (session, f"s{r['conv_id'] // 2}" if r["conv_id"] % 2 else None))
                link.execute("INSERT INTO session_transcript_active_events VALUES (?, ?, ?)", (session, r["turn"], seq))
                link.execute("INSERT INTO transcript_events VALUES (?, ?, ?, ?)", (session, seq, json.dumps({"type": "message", "message": {"role": r["role"], "content": r["text"]}}), 1704067200000 + r["turn"]))
                for n in range((1, 0, 2)[((r["conv_id"] + r["turn"]) % 20 == 7) + 2 * ((r["conv_id"] + r["turn"]) % 20 == 9)]):
                    link.execute("INSERT INTO transcript_event_identities VALUES (?, ?, ?)", (session, seq, f"{session}-{seq}-{n}"))
            link.commit()
            link.close()
            with open(f"{here}/x.db", "rb") as made, fs.open_output_stream(f"{root}/{key[0].as_py()}.db") as out:
                out.write(made.read())
        return pa.table({"file": [key[0].as_py()]})

    turns.select("conv_id", "turn", "role", "text").groupBy(F.floor(F.col("conv_id") / CONVERSATIONS_PER_FILE).alias("file")).applyInArrow(write, "file long").collect()  # numbers of files


def sqlite_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent databases made of all conversations: their tables joined inside each database."""
    folder = shared_folder(spark, "agents")
    _write_agent_databases(table(spark, sf_dir, "conversations"), folder)
    events, rejects = providers.openclaw_agent_events(spark, folder)
    kept = events.groupBy("provider_session_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"), F.sum(F.length("body")).alias("chars"), F.max("occurred_at_ms").alias("last_ms"), F.count("parent_session_id").alias("with_parent"))
    bad = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(bad.select(F.col("reason").alias("provider_session_id"), "n"), allowMissingColumns=True)


def streamed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of an event stream at its end equal those of the batch."""
    name = f"usage_{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    refresh.streamed_totals(stream, ["event_type"], "user_id", shared_folder(spark, "usage-mark"), name).awaitTermination()
    return spark.table(name)


QUERIES = {
    f.__name__: f
    for f in (
        ingest_custom_events, ingest_custom_rejects, ingest_codex, ingest_claude, ingest_gemini, ingest_pages, snapshot_published, snapshot_appended, source_changes, content_sum_of_documents, streamed_refresh, streamed_dialect, streamed_growing, routes_rolled_back, sqlite_joined, streamed_usage,
    )
}

_NULL = "NULL"
ORACLE_SQL = {
    "ingest_custom_events": """SELECT * FROM (VALUES
('a', 'n1', 0::BIGINT, 1704067200000::BIGINT, 'user', 'hello', NULL::VARCHAR, NULL::VARCHAR, 'a.rs,b.rs'),
('a', 'n1', 1, 1704067201000, 'assistant', 'hi there', NULL, NULL, NULL),
('a', 'n2', 0, 1704067202000, 'user', 'hello', 'forked', 'e0', NULL),
('a', 'n2', 1, NULL, NULL, 'notice', 'forked', NULL, NULL)) AS t(custom_source_id, provider_session_id, event_sequence, occurred_at_ms, role, body, session_relationship, copied_from, files)""",
    "ingest_custom_rejects": """SELECT * FROM (VALUES (4::BIGINT, 'duplicate'), (5, 'session of an unknown source'), (6, 'session is its own parent'), (8, 'edge from an unknown session'), (12, 'copied_from isn''t proven'),
(13, 'event of an unknown session'), (16, 'file reference without event_index'), (17, 'file reference to an unknown event'), (18, 'unknown record type'), (19, 'malformed')) AS t("offset", reason)""",
    "ingest_codex": """SELECT * FROM (VALUES (1::BIGINT, 'message', 'user', 'c1', NULL::VARCHAR, 'fix it', 0::BIGINT), (2, 'summary', 'assistant', 'c1', NULL, 'think', 0), (4, 'tool_call', 'assistant', 'c1', 'k1', NULL, 2),
(5, 'tool_output', 'tool', 'c1', 'k1', 'a.rs', 0), (6, 'message', 'system', 'c1', NULL, 'message system', 0), (8, 'summary', 'system', 'c1', NULL, 'so far', 0)) AS t(line, event_type, role, provider_session_id, call_id, body, n_facts)""",
    "ingest_claude": """SELECT * FROM (VALUES (0::BIGINT, 'message', 'user', NULL::VARCHAR, 'hello', ''), (64, 'message', 'assistant', NULL, 'one' || chr(10) || 'two', ''), (65, 'tool_call', 'assistant', 'Read', NULL, 'file=a.rs'),
(192, 'summary', 'unknown', NULL, 'all of it', ''), (256, 'notice', 'unknown', NULL, 'Claude event: file-history-snapshot', '')) AS t(event_sequence, event_type, role, tool, body, facts)""",
    "ingest_gemini": "SELECT * FROM (VALUES ('g1', 'message', 'user', 'question', 1704067200000::BIGINT), ('g2', 'message', 'assistant', 'answer', 1704067201000)) AS t(native_event_id, event_type, role, body, occurred_at_ms)",
    "ingest_pages": "SELECT page_id, strlen(html) AS bytes, sha256(html) AS digest FROM pages",
    "snapshot_published": f"WITH {TRANSCRIPT_SQL} SELECT 'conv-' || (session_id % 10) AS source_key, count(*) AS events, count(DISTINCT session_id) AS sessions FROM tr WHERE session_id % 10 <> 4 AND (session_id % 10 <> 3 OR event_sequence < 2) GROUP BY 1",
    "snapshot_appended": "SELECT DISTINCT 'conv-' || (conv_id % 10) AS source_key, true AS same FROM conversations",
    "source_changes": "WITH d AS (SELECT doc_id AS key, sha256(text) AS digest FROM documents), now AS (SELECT * FROM d WHERE key % 11 <> 0), was AS (SELECT key, CASE WHEN key % 7 = 0 THEN 'old' ELSE digest END AS digest FROM d WHERE key % 10 <> 0) SELECT coalesce(now.key, was.key) AS key, CASE WHEN was.key IS NULL THEN 'new' WHEN now.key IS NULL THEN 'gone' WHEN now.digest = was.digest THEN 'unchanged' ELSE 'stale' END AS change FROM now FULL OUTER JOIN was ON now.key = was.key",
    "content_sum_of_documents": "SELECT DISTINCT source, true AS same FROM documents",
    "streamed_refresh": "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role",
    "streamed_dialect": "SELECT role, count(*) AS n, count(*) AS n_ids, count(*) AS n_batch, count(DISTINCT conv_id % 100) AS sessions FROM conversations WHERE trim(text) <> '' GROUP BY role",
    "streamed_growing": """SELECT conv_id // 50 AS file, count(*) AS n, count(*) AS n_ids, count(*) AS n_batch, sum(length(text))::BIGINT AS chars, count(*) FILTER (turn % 3 > 0) AS n_appended
FROM conversations WHERE trim(text) <> '' GROUP BY 1""",
    "routes_rolled_back": """WITH c AS (SELECT conv_id % 10 AS k, count(*) FILTER (turn < 2) AS n_first, count(*) FILTER (turn >= 2) AS n_rest FROM conversations GROUP BY 1),
r AS (SELECT *, CASE WHEN k = 1 AND n_rest > 0 THEN 'repeated id' WHEN k = 2 AND n_rest > 0 THEN 'unknown event type' WHEN k = 3 THEN 'frontier moved' END AS reason FROM c)
SELECT 'conv-' || k AS source_key, CASE WHEN reason IS NULL THEN 'appended' ELSE 'failed' END AS verdict, reason, n_first + CASE WHEN reason IS NULL THEN n_rest ELSE 0 END AS n FROM r""",
    "sqlite_joined": """WITH t AS (SELECT *, CASE (conv_id + turn) % 20 WHEN 7 THEN 0 WHEN 9 THEN 2 ELSE 1 END AS identities FROM conversations)
SELECT 's' || conv_id AS provider_session_id, count(*) AS n, count(*) AS n_ids, sum(length(text))::BIGINT AS chars, max(1704067200000 + turn) AS last_ms, count(*) FILTER (WHERE conv_id % 2 = 1) AS with_parent FROM t WHERE identities = 1 AND trim(text) <> '' GROUP BY conv_id
UNION ALL SELECT identities || ' identities', count(*), NULL, NULL, NULL, NULL FROM t WHERE identities <> 1 GROUP BY identities""",
    "streamed_usage": "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS total FROM events GROUP BY event_type",
}
