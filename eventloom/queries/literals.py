"""Small literal tables for operators that no driver table can show.

The same rows make the DataFrame and the VALUES list of the DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import conform

EVENT_COLUMNS = "event_id session_id parent_session_id root_session_id session_relationship copy_ancestor_session_id copy_ancestor_event_id provider source_format provider_session_id event_sequence occurred_at_ms event_type role agent_scope policy_status discovery_exclusion body custom_provider_key custom_source_id".split()

_E = "00000000000000{:02x}aaaabbbbccccdddd"


def _event(n, session, seq, ms, kind, role, scope, body, parent=None, root=None, rel=None, anc_s=None, anc_e=None, provider="codex", fmt="codex_session_jsonl", psid=None, status="selected", excluded=None, ckey=None, cid=None, facts=()):
    eid = _E.format(n)
    return (eid, session, parent, root, rel, anc_s, None if anc_e is None else _E.format(anc_e), provider, fmt, psid, seq, ms, kind, role, scope, status, excluded, body, ckey, cid), list(facts)


ROWS = [
    _event(1, "s1", 0, 1000, "message", "user", "primary", "fix the parser in lexer.rs", root="s1", rel="root", psid="p1", facts=[("workspace", "/home/Ann/Project"), ("branch", "main"), ("file", "src/Lexer.rs")]),
    _event(2, "s1", 1, 1000, "message", "assistant", "primary", "I will read the lexer first", root="s1", rel="root", psid="p1", facts=[("file", "src/lexer.rs"), ("file", "README.md")]),
    _event(3, "s1", 2, 1500, "tool_call", "assistant", "primary", "cat lexer parser", root="s1", rel="root", psid="p1", facts=[("command", "cat src/lexer.rs"), ("tool_workdir", "/home/ann/project/sub")]),
    _event(4, "s1", 3, 1600, "tool_output", "tool", "primary", "fn parser lexer parser parser", root="s1", rel="root", psid="p1"),
    _event(5, "s1", 4, None, "message", "assistant", "primary", "the parser is fixed", root="s1", rel="root", psid="p1"),
    _event(6, "s1", 5, 2600, "message", "user", "primary", "<command-name>clear", root="s1", rel="root", psid="p1"),
    _event(7, "s2", 0, 2000, "message", "user", "subagent", "look for parser tests", parent="s1", root="s1", rel="delegated", psid="p2", facts=[("branch", "main"), ("project", "PROJECT-x")]),
    _event(8, "s2", 1, 2100, "message", "assistant", "subagent", "found three parser tests for the lexer", parent="s1", root="s1", rel="delegated", psid="p2"),
    _event(9, "s3", 0, 3000, "message", "user", None, "fix the parser in lexer.rs", parent="s2", root="s1", rel="forked", anc_s="s1", anc_e=1, provider="claude", fmt="claude_projects_jsonl_tree", psid="p3"),
    _event(10, "s3", 1, 3100, "summary", "assistant", None, "parser work summary", parent="s2", root="s1", rel="forked", provider="claude", fmt="claude_projects_jsonl_tree", psid="p3", facts=[("branch", "Main")]),
    _event(11, "s4", 0, 4000, "message", "user", "primary", "write release notes", provider="claude", fmt="claude_projects_jsonl_tree", psid="p4", anc_s="s9", anc_e=1),
    _event(12, "s4", 1, 4100, "command_output", "tool", "primary", "lexer built", provider="claude", fmt="claude_projects_jsonl_tree", psid="p4", status="redacted"),
    _event(13, "s5", 0, None, "notice", "system", None, "session resumed", provider="custom", fmt="ctx_history_jsonl_v1", psid="p5", ckey="acme", cid="one", rel="resumed_from", parent="s4"),
    _event(14, "s5", 1, None, "message", "user", "primary", "continue the parser notes", provider="custom", fmt="ctx_history_jsonl_v1", psid="p5", ckey="acme", cid="one", rel="resumed_from", parent="s4", excluded="retrieval", anc_s="s1", anc_e=1),
    _event(15, "s6", 0, 4000, "message", "user", "subagent", "lexer parser lexer parser release", provider="custom", fmt="ctx_history_jsonl_v1", psid="p1", ckey="acme", cid="two", parent="s7"),
    _event(16, "s7", 0, 3900, "artifact", "assistant", "primary", "parser table", provider="codex", psid="p7", parent="s6", anc_s="s1", anc_e=2, rel="workflow_child", facts=[("file", "docs/Table.md")]),
]


def events_fixture(spark: SparkSession) -> DataFrame:
    fact = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
    long_columns = {"event_sequence", "occurred_at_ms"}
    schema = T.StructType([*[T.StructField(c, T.LongType() if c in long_columns else T.StringType()) for c in EVENT_COLUMNS], T.StructField("facts", fact)])
    rows = spark.createDataFrame([(*row, facts) for row, facts in ROWS], schema)
    return conform(rows.withColumn("event_digest", rows["event_id"]))


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def events_sql(name: str = "ev") -> str:
    """A WITH item of the same events, facts as a list of structs."""
    lines = []
    for row, facts in ROWS:
        listed = "[" + ", ".join(f"{{'kind': {_sql(k)}, 'value': {_sql(v)}}}" for k, v in facts) + "]::STRUCT(kind VARCHAR, value VARCHAR)[]"
        lines.append("(" + ", ".join([*map(_sql, row), listed]) + ")")
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(lines)}) AS t({', '.join(EVENT_COLUMNS)}, facts))"
