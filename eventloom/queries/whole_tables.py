"""Filters, counts and classes over whole tables in the role of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text
from ..functions.text import shell_quoted
from ..operators import counts, diagnostics, filters, lineage, retrieval_class, search, sessions
from ..operators.vector_store import VectorStore
from ..snapshots import Snapshots
from .ingest import shared_folder
from .retrieval import TERMS, VECTOR_ID, _bm25_sql
from .tables import RANGE_SQL, TOKENS_SQL, TRANSCRIPT_SQL, document_events, range_events, table, transcript_events

RE = f"WITH {RANGE_SQL}"
TR = f"WITH {TRANSCRIPT_SQL}"


def documents_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_events(spark, sf_dir).filter(filters.EventFilters(provider="en").column()).select("event_id")


def documents_by_providers_and_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.EventFilters(providers=["de", "fr"], source_format=" src1 ")
    return document_events(spark, sf_dir).filter(chosen.column()).select("event_id")


def documents_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact source: here the document's source in the role of the source key."""
    rows = document_events(spark, sf_dir).withColumn("source_key", F.col("source_format"))
    return rows.filter(filters.EventFilters(source_key="src0").column()).select("event_id")


def events_outside_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_events(spark, sf_dir).filter(filters.not_in("session_id", [3, 4, 5])).select("event_id")


def events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.EventFilters(since_ms=1704672000000, event_type="error")
    return range_events(spark, sf_dir).filter(chosen.column()).select("event_id")


def turns_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.EventFilters(content_scope="transcript", role="assistant", agent_scope="primary")
    return transcript_events(spark, sf_dir).filter(chosen.column()).select("session_id", "event_sequence")


def turn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.status_totals(transcript_events(spark, sf_dir))


def document_source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_events(spark, sf_dir).select("event_id", F.col("source_format").alias("source_key"), F.col("provider").alias("session_id"), "body", F.lit("selected").alias("policy_status"))
    return counts.source_totals(rows)


def session_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proven roots of all conversations, with parents derived from their ids: chains, gaps,
    cycles, and claims that name an ancestor or none."""
    c = F.col("conv_id")
    parent = F.when(c % 13 == 4, c + 1).when(c % 13 == 5, c - 1).when(c % 11 == 3, -c - 1).when(c % 5 > 0, F.floor(c / 2))
    claimed = F.when(c % 7 == 1, F.floor(c / 2)).when(c % 7 == 2, c + 2)
    turns = table(spark, sf_dir, "conversations").select(c.alias("session_id"), parent.alias("parent_session_id"), claimed.alias("root_session_id"))
    return lineage.proven_roots(turns)


def vector_scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vector search among well rated events scanned, counted by the scan itself."""
    v = table(spark, sf_dir, "embeddings")
    chunks = v.select(F.floor(F.col("vec_id") / 4).alias("event_id"), (F.col("vec_id") % 4).cast("int").alias("chunk_index"), "embedding")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("event_id"))
    query = v.filter(F.col("vec_id") == VECTOR_ID).first()["embedding"]
    hits, seen = diagnostics.vector_scan(chunks, query, 20, good)
    hits.collect()  # 20 rows
    return spark.createDataFrame([tuple(seen.get.values())], ", ".join(f"{n} long" for n in seen.get))


def lexical_scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search over all documents scored."""
    path = shared_folder(spark, "tokens")
    search.with_tokens(document_events(spark, sf_dir)).select("event_id", "tokens", "doc_len").write.parquet(path)  # cut once, read for statistics and scores
    docs = spark.read.parquet(path)
    scored, seen = diagnostics.lexical_scan(docs, docs, TERMS)
    search.best_scores(scored, 20).collect()  # 20 rows
    return spark.createDataFrame([tuple(seen.get.values())], ", ".join(f"{n} long" for n in seen.get))


def vectors_caught_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents in two states: only new and changed texts are embedded again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("of"), "embedding")
    n = vectors.count()
    texts = lambda rows: rows.select(F.col("doc_id").cast("string").alias("event_id"), F.lit(0).alias("chunk_index"), F.sha2("text", 256).alias("source_text_hash"), "text")
    store = VectorStore(Snapshots(spark, shared_folder(spark, "vectors")))
    # The table's vectors in the role of a model: a text has that of its id.
    model = lambda rows: rows.withColumn("of", F.col("event_id").cast("long") % n).join(vectors, "of")
    first = store.catch_up(texts(docs.filter("doc_id % 3 <> 0")), model)
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))
    second = store.catch_up(texts(changed.filter("doc_id % 7 <> 0")), model)
    live = store.read()
    bare = live.agg(F.count(F.lit(1)).alias("live"), F.countDistinct("event_id").alias("events"), F.sum((F.size("embedding") > 0).cast("long")).alias("with_vector"))
    same = live.join(texts(changed).select("event_id", F.col("source_text_hash").alias("now")), "event_id").filter("source_text_hash = now").agg(F.count(F.lit(1)).alias("current"))
    done = [F.lit(x).cast("long").alias(name) for name, x in (("embedded_first", first["embedded"]), ("embedded_second", second["embedded"]), ("gone", second["gone"]))]
    return bare.crossJoin(same).select("live", "events", "with_vector", "current", *done)  # one row each


def session_first_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user's session in the order of its sequence."""
    return sessions.session_records(range_events(spark, sf_dir)).select("session_id", "event_id")


def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of every event; those with a repeated key have no authority."""
    key = F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))
    text = F.concat(F.lit('{"'), key, F.lit('": '), F.col("props"), F.lit(', "k1": [{"a": 0}, {"a": 1}]}'))
    return table(spark, sf_dir, "events").select("event_id", json_text.keys_are_unique(text).alias("unique_keys"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two names for an event's type; both, or an empty value, are ambiguous."""
    n = F.col("event_id") % 4
    kind = F.col("event_type")
    text = F.when(n == 0, F.format_string('{"kind": "%s"}', kind)).when(n == 1, F.format_string('{"kind": "%s", "type": "%s"}', kind, kind)).when(n == 2, '{"type": ""}').otherwise("{}")
    found = json_text.only_alias(text, ["kind", "type"])
    return table(spark, sf_dir, "events").select("event_id", found["state"].alias("state"), found["text"].alias("text"))


def quoted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", shell_quoted(F.col("event_type")).alias("kind"), shell_quoted(F.concat(F.col("props"), F.lit("'s"))).alias("props"))


ROUTES = retrieval_class.Routes("recall", ("find", "read turn"), ("tidy",))
COMMANDS = ["recall find 'a b'", "recall  tidy", "ls -l", "recall read turn 7 | cat", " recall read  turn 9"]


def result_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as calls and results: user turns call a command, assistants answer it."""
    turns = transcript_events(spark, sf_dir).withColumn("call", F.floor(F.col("event_sequence") / 3))
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), ((F.col("session_id") + F.col("event_sequence")) % 5 + 1).cast("int"))
    calls = turns.filter("role = 'user'").select("session_id", "call", retrieval_class.command_class(command, ROUTES).alias("class"))
    results = turns.filter("role = 'assistant'").withColumn("status", F.when(F.col("session_id") % 4 == 0, "failed").when(F.col("session_id") % 7 != 0, "succeeded"))
    found = retrieval_class.result_classes(results, calls, ["session_id", "call"])
    return found.select("event_id", "class", retrieval_class.exclusion(F.col("class")).alias("discovery_exclusion"))


QUERIES = {
    "documents_by_provider": documents_by_provider,
    "documents_by_providers_and_format": documents_by_providers_and_format,
    "documents_of_source": documents_of_source,
    "events_outside_sessions": events_outside_sessions,
    "events_since": events_since,
    "turns_by_role": turns_by_role,
    "turn_totals": turn_totals,
    "document_source_totals": document_source_totals,
    "session_first_by_user": session_first_by_user,
    "session_roots": session_roots,
    "vector_scan_counters": vector_scan_counters,
    "lexical_scan_counters": lexical_scan_counters,
    "vectors_caught_up": vectors_caught_up,
    "json_unique_keys": unique_keys,
    "json_aliases": aliases,
    "shell_quoted_words": quoted_words,
    "retrieval_result_classes": result_classes,
}



def roots_sql(sessions: str, before: str = "") -> str:
    """Proven roots of ``sessions`` (sid, parent, claimed), one row a session."""
    return f"""WITH RECURSIVE {before} s AS ({sessions}),
chain AS (SELECT sid, sid AS node, parent, claimed, 0 AS depth FROM s UNION ALL SELECT c.sid, s.sid, s.parent, s.claimed, c.depth + 1 FROM chain c JOIN s ON c.parent = s.sid WHERE c.depth <= 64),
tops AS (SELECT sid, max(depth) AS len, arg_max(node, depth) AS root, arg_max(parent IS NULL, depth) AS ended FROM chain GROUP BY sid),
bad AS (SELECT DISTINCT c.sid FROM chain c JOIN tops t ON c.sid = t.sid LEFT JOIN chain a ON a.sid = c.sid AND a.depth > c.depth AND a.node = c.claimed
WHERE c.claimed IS NOT NULL AND CASE WHEN c.depth = t.len THEN c.claimed <> c.node ELSE a.sid IS NULL END)
SELECT sid AS session_id, CASE WHEN ended AND len <= 64 AND sid NOT IN (SELECT sid FROM bad) THEN root END AS proven_root FROM tops"""


ORACLE_SQL = {
    "documents_by_provider": "SELECT doc_id AS event_id FROM documents WHERE lang = 'en'",
    "documents_by_providers_and_format": "SELECT doc_id AS event_id FROM documents WHERE lang IN ('de', 'fr') AND source = 'src1'",
    "documents_of_source": "SELECT doc_id AS event_id FROM documents WHERE source = 'src0'",
    "events_outside_sessions": f"{RE} SELECT event_id FROM re WHERE session_id IS NULL OR session_id NOT IN (3, 4, 5)",
    "events_since": f"{RE} SELECT event_id FROM re WHERE occurred_at_ms >= 1704672000000 AND event_type = 'error'",
    "turns_by_role": f"{TR} SELECT session_id, event_sequence FROM tr WHERE role = 'assistant'",
    "turn_totals": f"{TR} SELECT count(*) AS documents, count(DISTINCT session_id) AS sessions, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS semantic_eligible FROM tr",
    "document_source_totals": "SELECT source AS source_key, count(*) AS events, count(DISTINCT lang) AS sessions, sum(strlen(coalesce(text, '')))::BIGINT AS body_bytes, 0::BIGINT AS withheld FROM documents GROUP BY source",
    "session_first_by_user": f"{RE} SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_sequence, occurred_at_ms NULLS FIRST, event_id) AS rn FROM re) WHERE rn = 1",
    "session_roots": roots_sql(
        """SELECT DISTINCT conv_id AS sid,
CASE WHEN conv_id % 13 = 4 THEN conv_id + 1 WHEN conv_id % 13 = 5 THEN conv_id - 1 WHEN conv_id % 11 = 3 THEN -conv_id - 1 WHEN conv_id % 5 > 0 THEN conv_id // 2 END AS parent,
CASE conv_id % 7 WHEN 1 THEN conv_id // 2 WHEN 2 THEN conv_id + 2 END AS claimed FROM conversations"""
    ),
    "vector_scan_counters": f"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {VECTOR_ID}),
c AS (SELECT vec_id // 4 AS event_id, vec_id // 4 IN (SELECT doc_id FROM labels WHERE quality = 1) AS allowed, list_dot_product(embedding::DOUBLE[], q) AS s FROM embeddings, q),
e AS (SELECT event_id, bool_or(allowed) AS allowed, count(*) AS n, max(s) AS best FROM c GROUP BY 1)
SELECT count(*) AS events_seen, count(*) FILTER (WHERE allowed) AS events_scored, count(*) FILTER (WHERE NOT allowed) AS filtered_events, sum(n)::BIGINT AS chunks_seen,
coalesce(sum(n) FILTER (WHERE allowed), 0)::BIGINT AS chunks_scanned, coalesce(sum(n) FILTER (WHERE NOT allowed), 0)::BIGINT AS chunks_skipped, coalesce(sum(n) FILTER (WHERE allowed), 0)::BIGINT * 256 AS vector_bytes_read,
count(*) FILTER (WHERE allowed AND best <= 0) AS non_positive_events, greatest(count(*) FILTER (WHERE allowed AND best > 0) - 20, 0) AS rejected_events FROM e""",
    "lexical_scan_counters": f"""WITH {TOKENS_SQL}, {_bm25_sql(TERMS)}
SELECT count(*) AS events_scored, sum(doc_len)::BIGINT AS tokens_scored, count(*) FILTER (WHERE coverage = {len(TERMS)}) AS events_with_all_terms, max(coverage)::BIGINT AS greatest_coverage FROM scored JOIN lens USING (event_id)""",
    "vectors_caught_up": """SELECT count(*) FILTER (WHERE doc_id % 7 <> 0) AS live, count(*) FILTER (WHERE doc_id % 7 <> 0) AS events, count(*) FILTER (WHERE doc_id % 7 <> 0) AS with_vector, count(*) FILTER (WHERE doc_id % 7 <> 0) AS current,
count(*) FILTER (WHERE doc_id % 3 <> 0) AS embedded_first, count(*) FILTER (WHERE doc_id % 7 <> 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0)) AS embedded_second, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 7 = 0) AS gone FROM documents""",
    "json_unique_keys": "SELECT event_id, event_id % 3 <> 1 AS unique_keys FROM events",
    "json_aliases": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'exact' WHEN 3 THEN 'missing' ELSE 'ambiguous' END AS state, CASE WHEN event_id % 4 = 0 THEN event_type END AS text FROM events",
    "shell_quoted_words": "SELECT event_id, event_type AS kind, '''' || replace(props || '''s', '''', '''\\''''') || '''' AS props FROM events",
    "retrieval_result_classes": f"""{TR}, t AS (SELECT *, event_sequence // 3 AS call FROM tr),
c AS (SELECT session_id, call, CASE (session_id + event_sequence) % 5 WHEN 0 THEN 'derived' WHEN 4 THEN 'derived' WHEN 1 THEN 'ordinary' ELSE 'unknown' END AS class FROM t WHERE role = 'user'),
k AS (SELECT session_id, call, CASE WHEN bool_or(class = 'ordinary') THEN 'ordinary' WHEN bool_or(class = 'unknown') THEN 'unknown' ELSE 'derived' END AS class FROM c GROUP BY ALL),
r AS (SELECT event_id, CASE WHEN t.session_id % 4 = 0 THEN 'ordinary' WHEN t.session_id % 7 = 0 THEN 'unknown' ELSE coalesce(k.class, 'unknown') END AS class FROM t LEFT JOIN k ON k.session_id = t.session_id AND k.call = t.call WHERE role = 'assistant')
SELECT event_id, class, CASE WHEN class = 'derived' THEN 'retrieval_derived' END AS discovery_exclusion FROM r""",
}
