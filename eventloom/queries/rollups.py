"""Usage counters, normalisers and rollups over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, json_text, times, vectors
from ..operators import usage
from .tables import RANGE_SQL, USAGE_SQL, range_events, table, usage_rows

US = f"WITH {USAGE_SQL}"


def usage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of one half of the events added to those of the other."""
    rows = usage_rows(spark, sf_dir)
    base = usage.upsert(rows.filter("event_id % 2 = 0"), rows.limit(0))
    return usage.upsert(base, rows.filter("event_id % 2 = 1"))


def usage_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.retained(usage_rows(spark, sf_dir), "2024-01-02").select("day_utc", "operation", "calls")


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(usage_rows(spark, sf_dir))


def usage_active_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.active_range(usage_rows(spark, sf_dir))


def usage_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_operation(usage_rows(spark, sf_dir))


def usage_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.duration_histogram(usage_rows(spark, sf_dir))


def usage_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.versions(usage_rows(spark, sf_dir))


def usage_token_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *usage.token_range(F.octet_length("text")))


def usage_avoided(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = usage_rows(spark, sf_dir).groupBy("surface").agg(F.sum("matched_session_bytes").alias("m"), F.sum("delivered_context_bytes").alias("d"), F.sum(F.when(F.col("context_coverage") == "complete", F.col("calls")).otherwise(0)).alias("c"))
    return sums.select("surface", usage.avoided_bytes(F.col("m"), F.col("d"), F.col("c")).alias("avoided"))


def event_day_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage: calls and bytes by UTC day and type."""
    timed = range_events(spark, sf_dir).filter("occurred_at_ms IS NOT NULL")
    return timed.groupBy(times.utc_day(F.col("occurred_at_ms")).alias("day_utc"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("content_bytes").alias("bytes"), F.round(F.sum("value"), 2).alias("value"))


def lineitem_conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sums by flag over the fact table, one pass, no join."""
    items = table(spark, sf_dir, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(late, 1).otherwise(0)).alias("n_late"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.sum(F.when(late, F.col("l_extendedprice").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("late_price")
    )


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation and segment: the small sides are broadcast below the engine's size limit."""
    orders, customers, nations = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


TIMES = ["2024-03-01T10:20:30Z", "2024-03-01T10:20:30.123456+02:00", "2024-03-01 10:20:30.5", "1709288430", "1709288430.25", "1709288430123", "-5", "nan", "soon", "", None]


def time_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TIMES)], "id long, raw string")
    return rows.select("id", times.provider_ms(F.col("raw")).alias("ms"))


ROLES = ["user", "human", "user-prompt", "assistant", "agent", "ai", "model", "system", "developer", "tool", "tool-result", "tool_use_result", "bot", "", None]


def role_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(ROLES)], "id long, raw string")
    return rows.select("id", json_text.role(F.col("raw")).alias("role"))


VALUES = ['plain', '[{"type":"text","text":"one"},{"type":"tool_use","name":"grep"},{"type":"tool_result"},{"content":"two"}]', '["a","b"]', '{"k":1}', "12", "true", "null", "[]", None]


def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id long, raw string")
    return rows.select("id", json_text.value_text(F.col("raw")).alias("text"))


def props_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field out of every event's JSON."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", json_text.at(F.col("props"), "k").cast("long").alias("k"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text hash and the UUID made of it, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return docs.select("doc_id", "text_hash", identity.uuid8(F.col("text_hash")).alias("uuid"))


def embedding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that an embedder would get: prefix, header with limits, body."""
    docs = table(spark, sf_dir, "documents")
    header = vectors.header_value(F.substring("text", 1, 400), 80)
    return docs.select("doc_id", vectors.e5_passage(F.concat_ws("\n\n", header, F.col("lang"))).alias("text"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk spans of every whole document (no SQL: each end depends on the last)."""
    return vectors.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", source_chars=None).select(F.col("id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    unit = vectors.normalised(F.transform("embedding", lambda x: x.cast("double") * 3), 64)
    return v.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.norm(unit), 6).alias("unit_norm"))


QUERIES = {
    f.__name__: f
    for f in (
        usage_upsert, usage_retained, usage_summary, usage_active_range, usage_by_operation, usage_duration_histogram, usage_versions, usage_token_range, usage_avoided, event_day_usage,
        lineitem_conditional_sums, order_segments, time_normalised, role_mapping, value_texts, props_values, digests, embedding_documents, document_chunks, vector_norms,
    )
}

_KEY = ", ".join(usage.KEY)
_SUMS = ", ".join(f"sum({m})::BIGINT AS {m}" for m in usage.MEASURES)


def _values(rows: list, kind: str) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in rows]
    return ", ".join(f"({i}::BIGINT, {q}::{kind})" for i, q in enumerate(quoted))


ORACLE_SQL = {
    "usage_upsert": f"{US} SELECT {_KEY}, {_SUMS} FROM us GROUP BY {_KEY}",
    "usage_retained": f"{US} SELECT day_utc, operation, calls::BIGINT AS calls FROM us WHERE day_utc >= '2024-01-02'",
    "usage_summary": f"""{US} SELECT coalesce(sum(calls), 0)::BIGINT AS calls, coalesce(sum(CASE WHEN outcome = 'success' THEN calls ELSE 0 END), 0)::BIGINT AS succeeded,
coalesce(sum(CASE WHEN outcome = 'error' THEN calls ELSE 0 END), 0)::BIGINT AS failed, coalesce(sum(CASE WHEN value_class = 'useful' THEN calls ELSE 0 END), 0)::BIGINT AS useful_calls,
coalesce(sum(CASE WHEN value_class = 'empty' THEN calls ELSE 0 END), 0)::BIGINT AS empty_calls, coalesce(sum(CASE WHEN context_coverage = 'complete' THEN calls ELSE 0 END), 0)::BIGINT AS complete_calls,
coalesce(sum(result_count), 0)::BIGINT AS results, coalesce(sum(delivered_output_bytes), 0)::BIGINT AS output_bytes, coalesce(sum(delivered_context_bytes), 0)::BIGINT AS context_bytes,
coalesce(sum(CASE WHEN context_coverage = 'complete' THEN delivered_context_bytes ELSE 0 END), 0)::BIGINT AS complete_context_bytes,
coalesce(sum(CASE WHEN context_coverage = 'complete' THEN matched_session_bytes ELSE 0 END), 0)::BIGINT AS complete_matched_bytes,
coalesce(sum(CASE WHEN outcome <> 'success' AND value_class <> 'useful' THEN calls ELSE 0 END), 0)::BIGINT AS other_calls FROM us""",
    "usage_active_range": f"{US} SELECT min(day_utc) AS first_day, max(day_utc) AS last_day, count(DISTINCT day_utc) AS active_days FROM us",
    "usage_by_operation": f"{US} SELECT tool_version, surface, operation, {_SUMS} FROM us GROUP BY ALL",
    "usage_duration_histogram": f"{US} SELECT duration_bucket, sum(calls)::BIGINT AS calls, list_position(['lt_10ms', 'lt_100ms', 'lt_1s', 'lt_10s', 'ge_10s'], duration_bucket)::BIGINT AS place FROM us GROUP BY ALL",
    "usage_versions": f"{US} SELECT DISTINCT definition_version, tool_version FROM us",
    "usage_token_range": "SELECT doc_id, strlen(text) // 5 AS tokens_low, strlen(text) // 4 AS tokens_mid, strlen(text) * 2 // 5 AS tokens_high FROM documents",
    "usage_avoided": f"{US} SELECT surface, CASE WHEN sum(CASE WHEN context_coverage = 'complete' THEN calls ELSE 0 END) > 0 THEN (sum(matched_session_bytes) - sum(delivered_context_bytes))::BIGINT END AS avoided FROM us GROUP BY surface",
    "event_day_usage": f"WITH {RANGE_SQL} SELECT strftime(make_timestamp(occurred_at_ms * 1000), '%Y-%m-%d') AS day_utc, event_type, count(*) AS calls, sum(content_bytes)::BIGINT AS bytes, round(sum(value), 2) AS value FROM re WHERE occurred_at_ms IS NOT NULL GROUP BY 1, 2",
    "lineitem_conditional_sums": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END)::BIGINT AS n_late, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, sum(CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' THEN l_extendedprice::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS late_price FROM lineitem GROUP BY ALL",
    "order_segments": "SELECT n_name, c_mktsegment, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "time_normalised": "SELECT * FROM (VALUES (0::BIGINT, 1709288430000::BIGINT), (1, 1709281230123), (2, 1709288430500), (3, 1709288430000), (4, 1709288430250), (5, 1709288430123), (6, -5000), (7, NULL), (8, NULL), (9, NULL), (10, NULL)) AS t(id, ms)",
    "role_mapping": f"SELECT id, CASE WHEN raw IN ('user', 'human', 'user_prompt', 'user-prompt') THEN 'user' WHEN raw IN ('assistant', 'agent', 'ai', 'model') THEN 'assistant' WHEN raw IN ('system', 'developer', 'system_prompt', 'system-prompt') THEN 'system' WHEN raw IN ('tool', 'tool_result', 'tool-result', 'tool_use_result') THEN 'tool' ELSE 'unknown' END AS role FROM (VALUES {_values(ROLES, 'VARCHAR')}) AS t(id, raw)",
    "value_texts": "SELECT * FROM (VALUES (0::BIGINT, 'plain'), (1, 'one' || chr(10) || 'tool call: grep' || chr(10) || 'tool result' || chr(10) || 'two'), (2, 'a' || chr(10) || 'b'), (3, '{\"k\":1}'), (4, '12'), (5, 'true'), (6, NULL), (7, NULL), (8, NULL)) AS t(id, text)",
    "props_values": "SELECT event_id, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::BIGINT AS k FROM events",
    "digests": "WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, h AS text_hash, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', instr('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN instr('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM d",
    "embedding_documents": r"WITH d AS (SELECT doc_id, lang, trim(regexp_replace(substr(text, 1, 400), '\s+', ' ', 'g')) AS p FROM documents) SELECT doc_id, 'passage: ' || CASE WHEN length(p) > 80 THEN substr(p, 1, 80) || '...' ELSE p END || chr(10) || chr(10) || lang AS text FROM d",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings",
}
