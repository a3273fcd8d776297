"""Filters, ranges, sessions, lineage and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts, filters, lineage, lookup, projections, ranges, sessions
from .tables import RANGE_SQL, TABLE_EVENTS_SQL, TRANSCRIPT_SQL, range_events, table_events, transcript_events
from .whole_tables import roots_sql

EV = f"WITH {TABLE_EVENTS_SQL}"
RE = f"WITH {RANGE_SQL}"
TR = f"WITH {TRANSCRIPT_SQL}"
FACT_SQL = "len(list_filter(facts, lambda f: {test})) > 0"
WORKSPACE_SQL = FACT_SQL.format(test="f.kind IN ('workspace', 'session_cwd', 'tool_workdir', 'project') AND contains(lower(f.value), '{0}')")

#: name: the filter and the same as a SQL condition, over the conversations as events.
FILTERS: dict[str, tuple[filters.EventFilters, str]] = {
    "filter_discoverable": (filters.EventFilters(discoverable=True), "policy_status = 'selected' AND discovery_exclusion IS NULL"),
    "filter_provider": (filters.EventFilters(provider="claude"), "provider = 'claude'"),
    "filter_providers": (filters.EventFilters(providers=["custom", "claude"]), "provider IN ('claude', 'custom')"),
    "filter_format_and_session": (filters.EventFilters(source_format=" codex_session_jsonl ", provider_session_id="p1"), "source_format = 'codex_session_jsonl' AND provider_session_id = 'p1'"),
    "filter_session": (filters.EventFilters(session_id="s2"), "session_id = 's2'"),
    "filter_parent": (filters.EventFilters(parent_session_id="s1"), "parent_session_id = 's1'"),
    "filter_root": (filters.EventFilters(root_session_id="s1"), "root_session_id = 's1'"),
    "filter_excluded_sessions": (filters.EventFilters(excluded_sessions=["s1", "s4"]), "session_id NOT IN ('s1', 's4')"),
    "filter_branch": (filters.EventFilters(branch="main"), FACT_SQL.format(test="f.kind = 'branch' AND f.value = 'main'")),
    "filter_type_and_role": (filters.EventFilters(event_type="message", role="user"), "event_type = 'message' AND role = 'user'"),
    "filter_scope_transcript": (filters.EventFilters(content_scope="transcript"), "event_type IN ('message', 'summary')"),
    "filter_scope_calls": (filters.EventFilters(content_scope="calls"), "event_type IN ('tool_call', 'command_started')"),
    "filter_scope_outputs": (filters.EventFilters(content_scope="outputs"), "event_type IN ('tool_output', 'command_output', 'command_finished')"),
    "filter_workspace": (filters.EventFilters(workspace="PROJECT"), WORKSPACE_SQL.format("project")),
    "filter_file": (filters.EventFilters(file="lexer.RS"), FACT_SQL.format(test="f.kind = 'file' AND contains(lower(f.value), 'lexer.rs')")),
    "filter_since": (filters.EventFilters(since_ms=2600), "occurred_at_ms >= 2600"),
    "filter_range": (filters.EventFilters(since_ms=1500, until_ms=3100), "occurred_at_ms >= 1500 AND occurred_at_ms < 3100"),
    "filter_agent_scope": (filters.EventFilters(agent_scope="subagent"), "agent_scope = 'subagent'"),
    "filter_custom_source": (filters.EventFilters(custom_source="acme/one"), "provider = 'custom' AND custom_provider_key = 'acme' AND custom_source_id = 'one'"),
    "filter_custom_source_malformed": (filters.EventFilters(custom_source="acme"), "false"),
    "filter_combined": (filters.EventFilters(discoverable=True, root_session_id="s1", content_scope="transcript", since_ms=1000, agent_scope="primary"), "policy_status = 'selected' AND discovery_exclusion IS NULL AND root_session_id = 's1' AND event_type IN ('message', 'summary') AND occurred_at_ms >= 1000 AND agent_scope = 'primary'"),
}


def _filter_query(chosen: filters.EventFilters) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table_events(spark, sf_dir).filter(chosen.column()).select("event_id")


def filter_outside_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_events(spark, sf_dir).filter(filters.outside_tree(["s1"], "custom", "p5")).select("event_id")


def filter_semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_events(spark, sf_dir).filter(filters.semantic_candidate()).select("event_id")


def filter_id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows at most: enough to see that a prefix is ambiguous."""
    return lookup.by_prefix(table_events(spark, sf_dir), "000000000000000").select("event_id")


def filter_range_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open range over the event table; untimed rows are out."""
    chosen = filters.EventFilters(since_ms=1704672000000, until_ms=1705276800000, event_type="purchase")
    return range_events(spark, sf_dir).filter(chosen.column()).select("event_id", "occurred_at_ms")


def range_page_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.page(range_events(spark, sf_dir), 200).select(*ranges.KEYS, "event_id")


def range_page_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untimed events come first, the exact reverse of ascending."""
    return ranges.page(range_events(spark, sf_dir), 300, descending=True).select(*ranges.KEYS, "event_id")


CURSOR = (1704153600000, 3, "000000000500")


def range_page_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.page(range_events(spark, sf_dir), 250, CURSOR).select(*ranges.KEYS, "event_id")


def range_page_continued_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.page(range_events(spark, sf_dir), 250, CURSOR, descending=True).select(*ranges.KEYS, "event_id")


def range_page_untimed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behind the last timed event only untimed ones are left."""
    return ranges.page(range_events(spark, sf_dir), 4096, (None, 2, "000000000100")).select(*ranges.KEYS, "event_id")


def range_page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranges.page(range_events(spark, sf_dir).filter("event_type = 'click'"), ranges.MAX_PAGE)
    return ranges.within_budget(rows, 1000).select("event_id", "content_bytes")


def range_page_budget_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event larger than the budget is let through on its own."""
    rows = ranges.page(range_events(spark, sf_dir), 100)
    return ranges.within_budget(rows, 1).select("event_id", "content_bytes")


def page_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.keyset_page(range_events(spark, sf_dir), ["session_id", "event_digest"], 500, (3, "000000000400")).select("session_id", "event_digest")


def session_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_records(transcript_events(spark, sf_dir)).select("session_id", "event_id", "role", "event_sequence")


def session_first_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_records(table_events(spark, sf_dir)).select("session_id", "event_id", "provider", "agent_scope")


def session_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.prefix(transcript_events(spark, sf_dir), 3).select("session_id", "event_id", F.col("place").cast("long").alias("place"))


def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.window_around(transcript_events(spark, sf_dir), 12003, 2, 1).select("event_id", "role", F.col("distance").cast("long").alias("distance"))


def session_full_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.full_mode(table_events(spark, sf_dir)).select("event_id")


def session_lite_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.lite_mode(transcript_events(spark, sf_dir)).select("event_id", "role")


def session_page_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_page(transcript_events(spark, sf_dir), 12, "lite", 3).select("event_id", "role")


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.turns(transcript_events(spark, sf_dir)).select("event_id", "assistant_text")


def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.order_violations(transcript_events(spark, sf_dir)).select("event_id", "n")


def copy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.copy_sources(table_events(spark, sf_dir))


def copies_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.copies_of(table_events(spark, sf_dir), "0000000000000001aaaabbbbccccdddd")


def copy_relationship_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.relationship_counts(table_events(spark, sf_dir), "0000000000000001aaaabbbbccccdddd")


def session_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineage.session_tree(spark, table_events(spark, sf_dir), ["s2"]) or []
    return spark.createDataFrame([(s,) for s in found], "session_id string")


def proven_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions' roots; ``whole_tables.session_roots`` has gaps, cycles and false claims too."""
    return lineage.proven_roots(table_events(spark, sf_dir))


def hydrate_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested order is kept in ``ordinal``."""
    found = lookup.by_ids(transcript_events(spark, sf_dir), [12001, 3000, 7002])
    return found.select(F.col("ordinal").cast("long").alias("ordinal"), "event_id", "role")


def resolve_provider_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.sessions_by_provider_id(table_events(spark, sf_dir), "p1")


def locate_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.locate(table_events(spark, sf_dir), "0000000000000009")


def shortest_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.shortest_unique(table_events(spark, sf_dir))


def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.status_totals(table_events(spark, sf_dir))


def session_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.session_count(transcript_events(spark, sf_dir))


def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.event_type_counts(range_events(spark, sf_dir))


def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.source_totals(table_events(spark, sf_dir).withColumn("source_key", F.concat_ws("/", "provider", "provider_session_id")))


def body_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_events(spark, sf_dir).select("event_id", projections.body_search().alias("body_search"))


def content_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = projections.content(table_events(spark, sf_dir), "text")
    return shown.select("event_id", "body", F.size("facts").cast("long").alias("n_facts"))


_PLAIN = (
    filter_outside_tree, filter_semantic_candidates, filter_id_prefix, filter_range_events, range_page_ascending, range_page_descending, range_page_continued,
    range_page_continued_descending, range_page_untimed_tail, range_page_budget, range_page_budget_singleton, page_by_session, session_first_events, session_first_fixture,
    session_prefix, session_window, session_full_mode, session_lite_mode, session_page_lite, session_turns, order_violations, copy_sources, copies_of_event,
    copy_relationship_counts, session_tree, proven_roots, hydrate_by_ids, resolve_provider_session, locate_event, shortest_references, status_totals, session_count,
    event_type_counts, source_totals, body_projection, content_projection,
)

QUERIES = {name: _filter_query(chosen) for name, (chosen, _) in FILTERS.items()} | {f.__name__: f for f in _PLAIN}

_KEYS = "occurred_at_ms, event_sequence, event_digest, event_id"
_ASC = "ORDER BY occurred_at_ms NULLS LAST, event_sequence, event_digest"
_DESC = "ORDER BY occurred_at_ms DESC NULLS FIRST, event_sequence DESC, event_digest DESC"
_AFTER = "(occurred_at_ms IS NULL OR (occurred_at_ms, event_sequence, event_digest) > (1704153600000, 3, '000000000500'))"
_BEFORE = "(occurred_at_ms IS NOT NULL AND (occurred_at_ms, event_sequence, event_digest) < (1704153600000, 3, '000000000500'))"
_E1 = "'0000000000000001aaaabbbbccccdddd'"

ORACLE_SQL = {name: f"{EV} SELECT event_id FROM ev WHERE {test}" for name, (_, test) in FILTERS.items()} | {
    "filter_outside_tree": f"{EV} SELECT event_id FROM ev WHERE NOT (session_id = 's1' OR coalesce(parent_session_id, '') = 's1' OR coalesce(root_session_id, '') = 's1' OR (provider = 'custom' AND coalesce(provider_session_id, '') = 'p5'))",
    "filter_semantic_candidates": f"{EV} SELECT event_id FROM ev WHERE event_type = 'message' AND role = 'user' AND policy_status = 'selected' AND discovery_exclusion IS NULL AND copy_ancestor_event_id IS NULL AND NOT starts_with(ltrim(body), '<command-name>')",
    "filter_id_prefix": f"{EV} SELECT event_id FROM ev WHERE starts_with(event_id, '000000000000000') ORDER BY event_id LIMIT 2",
    "filter_range_events": f"{RE} SELECT event_id, occurred_at_ms FROM re WHERE occurred_at_ms >= 1704672000000 AND occurred_at_ms < 1705276800000 AND event_type = 'purchase'",
    "range_page_ascending": f"{RE} SELECT {_KEYS} FROM re {_ASC} LIMIT 200",
    "range_page_descending": f"{RE} SELECT {_KEYS} FROM re {_DESC} LIMIT 300",
    "range_page_continued": f"{RE} SELECT {_KEYS} FROM re WHERE {_AFTER} {_ASC} LIMIT 250",
    "range_page_continued_descending": f"{RE} SELECT {_KEYS} FROM re WHERE {_BEFORE} {_DESC} LIMIT 250",
    "range_page_untimed_tail": f"{RE} SELECT {_KEYS} FROM re WHERE occurred_at_ms IS NULL AND (event_sequence, event_digest) > (2, '000000000100') {_ASC} LIMIT 4096",
    "range_page_budget": f"{RE}, p AS (SELECT * FROM re WHERE event_type = 'click' {_ASC} LIMIT 4096), s AS (SELECT *, sum(content_bytes) OVER ({_ASC} ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER ({_ASC}) AS nth FROM p) SELECT event_id, content_bytes FROM s WHERE run <= 1000 OR nth = 1",
    "range_page_budget_singleton": f"{RE} SELECT event_id, content_bytes FROM re {_ASC} LIMIT 1",
    "page_by_session": f"{RE} SELECT session_id, event_digest FROM re WHERE (session_id, event_digest) > (3, '000000000400') ORDER BY session_id, event_digest LIMIT 500",
    "session_first_events": f"{TR} SELECT session_id, event_id, role, event_sequence FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_sequence, event_id) AS rn FROM tr) WHERE rn = 1",
    "session_first_fixture": f"{EV} SELECT session_id, event_id, provider, agent_scope FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_sequence, occurred_at_ms NULLS FIRST, event_id) AS rn FROM ev) WHERE rn = 1",
    "session_prefix": f"{TR} SELECT session_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_sequence, event_id) AS place FROM tr) WHERE place <= 3",
    "session_window": f"{TR}, p AS (SELECT *, row_number() OVER (ORDER BY event_sequence, event_id) AS place FROM tr WHERE session_id = (SELECT session_id FROM tr WHERE event_id = 12003)) SELECT event_id, role, place - (SELECT place FROM p WHERE event_id = 12003) AS distance FROM p WHERE place - (SELECT place FROM p WHERE event_id = 12003) BETWEEN -2 AND 1",
    "session_full_mode": f"{EV} SELECT event_id FROM ev WHERE event_type = 'message' AND role IN ('user', 'assistant', 'system')",
    "session_lite_mode": f"{TR}, t AS (SELECT *, lead(role) OVER (PARTITION BY session_id ORDER BY event_sequence, event_id) AS following FROM tr WHERE role IN ('user', 'assistant')) SELECT event_id, role FROM t WHERE role = 'user' OR following IS NULL OR following = 'user'",
    "session_page_lite": f"{TR}, t AS (SELECT *, lead(role) OVER (ORDER BY event_sequence, event_id) AS following FROM tr WHERE session_id = 12 AND role IN ('user', 'assistant')) SELECT event_id, role FROM t WHERE role = 'user' OR following IS NULL OR following = 'user' ORDER BY event_sequence, event_id LIMIT 3",
    "session_turns": f"{TR}, t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_sequence, event_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM tr WHERE role IN ('user', 'assistant')) SELECT max(CASE WHEN role = 'user' THEN event_id END) AS event_id, arg_max(body, event_sequence) FILTER (WHERE role = 'assistant' AND trim(body) <> '') AS assistant_text FROM t WHERE turn_no > 0 GROUP BY session_id, turn_no",
    "order_violations": f"{TR} SELECT event_id, count(*) AS n FROM tr GROUP BY event_id HAVING count(*) > 1",
    "copy_sources": f"{EV} SELECT c.event_id, c.copy_ancestor_event_id AS ancestor_event_id, a.event_id IS NOT NULL AS resolved FROM ev c LEFT JOIN ev a ON a.event_id = c.copy_ancestor_event_id AND a.session_id = c.copy_ancestor_session_id WHERE c.copy_ancestor_event_id IS NOT NULL",
    "copies_of_event": f"{EV} SELECT event_id, session_id, coalesce(session_relationship, 'unspecified') AS relationship FROM ev WHERE copy_ancestor_event_id = {_E1} ORDER BY event_id LIMIT 20",
    "copy_relationship_counts": f"{EV} SELECT CASE WHEN session_relationship IN ('root', 'delegated', 'forked', 'resumed_from', 'workflow_child') THEN session_relationship ELSE 'unspecified' END AS relationship, count(*) AS n FROM ev WHERE copy_ancestor_event_id = {_E1} GROUP BY 1",
    "session_tree": f"WITH RECURSIVE {TABLE_EVENTS_SQL}, e AS (SELECT session_id AS a, parent_session_id AS b FROM ev WHERE parent_session_id IS NOT NULL UNION SELECT session_id, root_session_id FROM ev WHERE root_session_id IS NOT NULL UNION SELECT parent_session_id, session_id FROM ev WHERE parent_session_id IS NOT NULL UNION SELECT root_session_id, session_id FROM ev WHERE root_session_id IS NOT NULL), r(session_id) AS (SELECT 's2' UNION SELECT e.b FROM r JOIN e ON e.a = r.session_id) SELECT session_id FROM r",
    "proven_roots": roots_sql("SELECT DISTINCT session_id AS sid, parent_session_id AS parent, root_session_id AS claimed FROM ev", f"{TABLE_EVENTS_SQL},"),
    "hydrate_by_ids": f"{TR} SELECT w.ordinal, tr.event_id, tr.role FROM (VALUES (0::BIGINT, 12001), (1, 3000), (2, 7002)) AS w(ordinal, id) JOIN tr ON tr.event_id = w.id",
    "resolve_provider_session": f"{EV} SELECT DISTINCT session_id, provider FROM ev WHERE provider_session_id = 'p1' ORDER BY session_id LIMIT 2",
    "locate_event": f"{EV} SELECT event_id, session_id, provider, source_format, provider_session_id FROM ev WHERE starts_with(event_id, '0000000000000009') ORDER BY event_id LIMIT 2",
    "shortest_references": f"{EV}, p AS (SELECT event_id, n FROM ev, range(8, 33) t(n)), u AS (SELECT substr(event_id, 1, n) AS prefix, n, count(*) AS c, min(event_id) AS event_id FROM p GROUP BY 1, 2) SELECT event_id, arg_min(prefix, n) AS reference FROM u WHERE c = 1 GROUP BY event_id",
    "status_totals": f"{EV} SELECT count(*) AS documents, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE event_type = 'message') AS messages, count(*) FILTER (WHERE event_type = 'message' AND role = 'user') AS semantic_eligible FROM ev",
    "session_count": f"{TR} SELECT count(DISTINCT session_id) AS sessions FROM tr",
    "event_type_counts": f"{RE} SELECT event_type, count(*) AS n FROM re GROUP BY event_type",
    "source_totals": f"{EV} SELECT provider || '/' || provider_session_id AS source_key, count(*) AS events, count(DISTINCT session_id) AS sessions, sum(strlen(coalesce(body, '')))::BIGINT AS body_bytes, count(*) FILTER (WHERE policy_status <> 'selected') AS withheld FROM ev GROUP BY 1",
    "body_projection": f"{EV} SELECT event_id, CASE WHEN policy_status = 'selected' AND discovery_exclusion IS NULL THEN nullif(concat_ws(chr(10), body, CASE WHEN len(facts) > 0 THEN list_reduce(list_transform(facts, lambda f: f.value), lambda a, b: a || chr(10) || b) END), '') END AS body_search FROM ev",
    "content_projection": f"{EV} SELECT event_id, body, CAST(NULL AS BIGINT) AS n_facts FROM ev",
}
