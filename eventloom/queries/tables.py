"""The driver's tables in the role of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from ..schema import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as untimed message events."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"),
        F.col("conv_id").alias("session_id"),
        F.lit(None).cast("long").alias("root_session_id"),
        F.col("turn").alias("event_sequence"),
        F.lit(None).cast("long").alias("occurred_at_ms"),
        F.lit("message").alias("event_type"),
        "role",
        F.lit("primary").alias("agent_scope"),
        F.col("text").alias("body"),
    )


TRANSCRIPT_SQL = "tr AS (SELECT conv_id * 1000 + turn AS event_id, conv_id AS session_id, turn AS event_sequence, role, text AS body FROM conversations)"


def range_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed events of sessions named by user; every 50th is untimed here."""
    events = table(spark, sf_dir, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return events.select(
        "event_id",
        F.col("user_id").alias("session_id"),
        (F.col("event_id") % 7).alias("event_sequence"),
        F.when(F.col("event_id") % 50 != 0, ms).alias("occurred_at_ms"),
        "event_type",
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_digest"),
        F.length("props").cast("long").alias("content_bytes"),
        "value",
        "props",
    )


RANGE_SQL = (
    "re AS (SELECT event_id, user_id AS session_id, event_id % 7 AS event_sequence, CASE WHEN event_id % 50 <> 0 THEN epoch_us(ts) // 1000 END AS occurred_at_ms, "
    "event_type, lpad(event_id::VARCHAR, 12, '0') AS event_digest, length(props)::BIGINT AS content_bytes, value, props FROM events)"
)


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events of every kind: what the table doesn't have is derived from its numbers.

    Sessions are families of eight with parents, roots and copies of the first one's
    first event; providers, types, times, scopes and facts follow the ids.
    """
    c, t = F.col("conv_id"), F.col("turn")
    k = F.pmod(c + 7, F.lit(8))
    base = c - k
    session = lambda n: F.concat(F.lit("s"), n.cast("string"))
    event = lambda conv, turn: F.format_string("%016xaaaabbbbccccdddd", turn * (1 << 32) + conv)
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"))
    provider = F.when(c % 3 == 1, "codex").when(c % 3 == 0, "claude").otherwise("custom")
    n = F.pmod(c + t, F.lit(10))
    copied = (t == 0) & k.isin(2, 3, 6)
    m = F.pmod(c + t, F.lit(4))
    facts = (
        F.when(m == 0, F.array(fact("workspace", "/home/Ann/Project"), fact("branch", "main")))
        .when(m == 1, F.array(fact("file", "src/Lexer.rs"), fact("file", "README.md")))
        .when(m == 2, F.array(fact("branch", "Main"), fact("project", "PROJECT-x")))
        .otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    )
    columns = {
        "event_id": event(c, t),
        "event_digest": event(c, t),
        "session_id": session(c),
        "parent_session_id": F.when(k.between(1, 5), session(base + F.floor(k / 2))),
        "root_session_id": F.when(k <= 3, session(base)),
        "session_relationship": F.get(F.array(*map(F.lit, ("root", "delegated", "forked", "resumed_from", "workflow_child"))), k.cast("int")),
        "copy_ancestor_session_id": F.when(copied, F.when(k == 6, "s-1").otherwise(session(base))),
        "copy_ancestor_event_id": F.when(copied, event(base, F.lit(0).cast("long"))),
        "provider": provider,
        "source_format": F.when(c % 3 == 1, "codex_session_jsonl").when(c % 3 == 0, "claude_projects_jsonl_tree").otherwise("custom_history_jsonl"),
        "provider_session_id": F.concat(F.lit("p"), (c % 1000).cast("string")),
        "event_sequence": t,
        "occurred_at_ms": F.when((c + t) % 9 != 0, c * 1000 + t * 100),
        "event_type": F.when(n < 6, "message").when(n == 6, "summary").when(n == 7, "tool_call").when(n == 8, "tool_output").otherwise("notice"),
        "role": F.col("role"),
        "agent_scope": F.when(c % 5 == 3, "subagent").when(c % 5 != 0, "primary"),
        "policy_status": F.when((c + 2 * t) % 11 == 0, "redacted").otherwise("selected"),
        "discovery_exclusion": F.when((c + t) % 13 == 0, "retrieval"),
        "body": F.col("text"),
        "custom_provider_key": F.when(c % 3 == 2, "acme"),
        "custom_source_id": F.when(c % 3 == 2, F.when(c % 2 == 0, "two").otherwise("one")),
        "facts": facts,
    }
    return conform(table(spark, sf_dir, "conversations").select(*[v.alias(name) for name, v in columns.items()]))


TABLE_EVENTS_SQL = """ev AS (SELECT printf('%016x', turn * 4294967296 + conv_id) || 'aaaabbbbccccdddd' AS event_id, 's' || conv_id AS session_id,
CASE WHEN k BETWEEN 1 AND 5 THEN 's' || (conv_id - k + k // 2) END AS parent_session_id, CASE WHEN k <= 3 THEN 's' || (conv_id - k) END AS root_session_id,
CASE k WHEN 0 THEN 'root' WHEN 1 THEN 'delegated' WHEN 2 THEN 'forked' WHEN 3 THEN 'resumed_from' WHEN 4 THEN 'workflow_child' END AS session_relationship,
CASE WHEN turn = 0 AND k = 6 THEN 's-1' WHEN turn = 0 AND k IN (2, 3) THEN 's' || (conv_id - k) END AS copy_ancestor_session_id,
CASE WHEN turn = 0 AND k IN (2, 3, 6) THEN printf('%016x', conv_id - k) || 'aaaabbbbccccdddd' END AS copy_ancestor_event_id,
CASE conv_id % 3 WHEN 1 THEN 'codex' WHEN 0 THEN 'claude' ELSE 'custom' END AS provider,
CASE conv_id % 3 WHEN 1 THEN 'codex_session_jsonl' WHEN 0 THEN 'claude_projects_jsonl_tree' ELSE 'custom_history_jsonl' END AS source_format,
'p' || (conv_id % 1000) AS provider_session_id, turn AS event_sequence, CASE WHEN (conv_id + turn) % 9 <> 0 THEN conv_id * 1000 + turn * 100 END AS occurred_at_ms,
CASE WHEN n < 6 THEN 'message' WHEN n = 6 THEN 'summary' WHEN n = 7 THEN 'tool_call' WHEN n = 8 THEN 'tool_output' ELSE 'notice' END AS event_type, role,
CASE WHEN conv_id % 5 = 3 THEN 'subagent' WHEN conv_id % 5 <> 0 THEN 'primary' END AS agent_scope,
CASE WHEN (conv_id + 2 * turn) % 11 = 0 THEN 'redacted' ELSE 'selected' END AS policy_status, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'retrieval' END AS discovery_exclusion, text AS body,
CASE WHEN conv_id % 3 = 2 THEN 'acme' END AS custom_provider_key, CASE WHEN conv_id % 3 = 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'two' ELSE 'one' END END AS custom_source_id,
CASE (conv_id + turn) % 4 WHEN 0 THEN [{'kind': 'workspace', 'value': '/home/Ann/Project'}, {'kind': 'branch', 'value': 'main'}] WHEN 1 THEN [{'kind': 'file', 'value': 'src/Lexer.rs'}, {'kind': 'file', 'value': 'README.md'}]
WHEN 2 THEN [{'kind': 'branch', 'value': 'Main'}, {'kind': 'project', 'value': 'PROJECT-x'}] ELSE []::STRUCT(kind VARCHAR, value VARCHAR)[] END AS facts
FROM (SELECT *, (conv_id + 7) % 8 AS k, (conv_id + turn) % 10 AS n FROM conversations))"""


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage counters, a call each: surfaces, versions, outcomes and sizes follow their columns."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    size = F.length("props").cast("long")
    failed = F.col("event_type") == "error"
    return e.select(
        n,
        F.date_format("ts", "yyyy-MM-dd").alias("day_utc"),
        F.when(n % 5 == 0, "2").otherwise("1").alias("definition_version"),
        F.when(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"), "0.2").otherwise("0.1").alias("tool_version"),
        F.when(F.col("user_id") % 2 == 0, "cli").otherwise("mcp").alias("surface"),
        F.col("event_type").alias("operation"),
        F.when(failed, "error").otherwise("success").alias("outcome"),
        F.when(failed, "other").when(n % 3 == 0, "empty").otherwise("useful").alias("value_class"),
        usage.duration_bucket(n * 7 % 20_000).alias("duration_bucket"),
        F.when(n % 4 == 0, "none").when(n % 4 == 1, "partial").otherwise("complete").alias("context_coverage"),
        F.lit(1).cast("long").alias("calls"),
        (n % 50).alias("result_count"),
        (size * 3).alias("delivered_output_bytes"),
        size.alias("delivered_context_bytes"),
        (size * (5 + n % 7)).alias("matched_session_bytes"),
    )


USAGE_SQL = """us AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_utc, CASE WHEN event_id % 5 = 0 THEN '2' ELSE '1' END AS definition_version,
CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN '0.2' ELSE '0.1' END AS tool_version, CASE WHEN user_id % 2 = 0 THEN 'cli' ELSE 'mcp' END AS surface, event_type AS operation,
CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS outcome, CASE WHEN event_type = 'error' THEN 'other' WHEN event_id % 3 = 0 THEN 'empty' ELSE 'useful' END AS value_class,
CASE WHEN ms < 10 THEN 'lt_10ms' WHEN ms < 100 THEN 'lt_100ms' WHEN ms < 1000 THEN 'lt_1s' WHEN ms < 10000 THEN 'lt_10s' ELSE 'ge_10s' END AS duration_bucket,
CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'complete' END AS context_coverage, 1::BIGINT AS calls, event_id % 50 AS result_count,
size * 3 AS delivered_output_bytes, size AS delivered_context_bytes, size * (5 + event_id % 7) AS matched_session_bytes
FROM (SELECT *, event_id * 7 % 20000 AS ms, length(props)::BIGINT AS size FROM events))"""


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a text corpus: language as provider, source as format."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("event_id"), F.col("lang").alias("provider"), F.col("source").alias("source_format"), F.col("text").alias("body"))


TOKENS_SQL = """runs AS (SELECT doc_id AS event_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS run FROM documents),
toks AS (SELECT event_id, lower(substr(run, (i * 24 + 1)::BIGINT, 32)) AS term FROM runs, unnest(generate_series(0, CASE WHEN length(run) > 32 THEN ceil((length(run) - 32) / 24.0)::BIGINT ELSE 0 END)) AS g(i)),
lens AS (SELECT d.doc_id AS event_id, count(t.term) AS doc_len FROM documents d LEFT JOIN toks t ON t.event_id = d.doc_id GROUP BY d.doc_id)"""
