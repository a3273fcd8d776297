"""The event record: one row per normalised event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

CORE_EVENT = T.StructType(
    [
        T.StructField("source_key", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("source_format", T.StringType()),
        T.StructField("custom_provider_key", T.StringType()),
        T.StructField("custom_source_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_digest", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("parent_session_id", T.StringType()),
        T.StructField("root_session_id", T.StringType()),
        T.StructField("session_relationship", T.StringType()),
        T.StructField("copy_ancestor_session_id", T.StringType()),
        T.StructField("copy_ancestor_event_id", T.StringType()),
        T.StructField("copy_proof", T.StringType()),
        T.StructField("provider_session_id", T.StringType()),
        T.StructField("native_event_id", T.StringType()),
        T.StructField("event_sequence", T.LongType()),
        T.StructField("occurred_at_ms", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("agent_scope", T.StringType()),
        T.StructField("policy_status", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("structured_content", T.StringType()),
        T.StructField("discovery_exclusion", T.StringType()),
        T.StructField("call_id", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("server", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("arguments", T.StringType()),
        T.StructField("result_status", T.StringType()),
        T.StructField("result_text", T.StringType()),
        T.StructField("result_structured", T.StringType()),
        T.StructField("facts", T.ArrayType(FACT)),
    ]
)

# The closed sets of the record format.
EVENT_TYPES = ("message", "tool_call", "tool_output", "command_started", "command_output", "command_finished", "artifact", "summary", "notice")
ROLES = ("user", "assistant", "system", "tool", "unknown")
RELATIONSHIPS = ("root", "delegated", "forked", "resumed_from", "workflow_child")
AGENT_SCOPES = ("primary", "subagent")
POLICY_STATUSES = ("selected", "redacted", "omitted")
FACT_KINDS = ("session_cwd", "tool_workdir", "file", "url", "forge", "project", "vcs", "commit", "pull_request", "command", "branch", "workspace", "provider_disposition")
CONTENT_SCOPES = {
    "all": None,
    "transcript": ("message", "summary"),
    "calls": ("tool_call", "command_started"),
    "outputs": ("tool_output", "command_output", "command_finished"),
}

MAX_CONTENT_BYTES = 16 << 20
MAX_FACTS = 4096


def conform(df: DataFrame) -> DataFrame:
    """``df`` with all event columns in order and type; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in CORE_EVENT])
