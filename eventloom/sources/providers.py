"""Dialects of transcript formats, as data over one projection.

A dialect says where a format keeps its session, id, time, role, kind and
content; ``project`` turns records (file, offset, value: JSON) into events.
Formats whose records become several events, and the two with kinds of their
own, have their projections below.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest, uuid8
from ..functions.json_text import at, block_text, elements, event_type, first_text, literal_facts, message_id, role, value_text
from ..functions.times import first_ms
from ..schema import conform
from .sqlite import Joined, read_joined

# Keys of the formats that state a fact.
COMMON_FACTS = {
    "cwd": "session_cwd", "workdir": "tool_workdir", "working_directory": "tool_workdir", "file": "file", "file_path": "file", "path": "file", "url": "url", "uri": "url",
    "project": "project", "repository": "vcs", "repo": "vcs", "commit": "commit", "sha": "commit", "pull_request": "pull_request", "command": "command", "cmd": "command", "branch": "branch", "workspace": "workspace",
}
CLAUDE_FACTS = COMMON_FACTS | {"cwd": "tool_workdir", "gitBranch": "branch", "repository": "project", "repo": "project", "filePath": "file"}


@dataclass(frozen=True)
class Dialect:
    """Paths are tried in order; ``kinds`` maps a record's kind to (event type, role)."""

    source_format: str
    provider: str
    session: tuple[str, ...] = ("sessionId", "session_id")
    native_id: tuple[str, ...] = ("id", "uuid")
    parent: tuple[str, ...] = ("parentSessionId", "parent_session_id")
    root: tuple[str, ...] = ("rootSessionId", "root_session_id")
    time: tuple[str, ...] = ("timestamp", "created_at", "createdAt", "time.created")
    role: tuple[str, ...] = ("message.role", "role", "type")
    kind: tuple[str, ...] = ("type",)
    content: tuple[str, ...] = ("message.content", "content", "text")
    message: tuple[str, ...] = ("message",)
    facts: dict = field(default_factory=lambda: COMMON_FACTS)
    kinds: dict = field(default_factory=dict)
    skipped: tuple[str, ...] = ()
    family: str = "jsonl"
    table: str = ""
    columns: tuple[str, ...] = ()
    #: Paths of ids that no two records share; None: those of ``native_id``. Records
    #: without one are known by their place, as are all with ``()``.
    unique_id: tuple[str, ...] | None = None
    #: (path, text that must be in it or None, event type): what a record holds decides before its kind.
    present: tuple[tuple[str, str | None, str], ...] = ()
    #: (path, words before it): the text of records that have no other.
    phrases: tuple[tuple[str, str], ...] = ()
    #: Where a record names its author, and the roles of these; before its kind's role.
    author: str | None = None
    authors: dict = field(default_factory=dict)
    #: (event type, role) of kinds that aren't listed; None: by the message's own fields.
    other: tuple[str, str] | None = None


def _jsonl(name: str, provider: str, **more) -> Dialect:
    return Dialect(name, provider, **more)


def _sqlite(name: str, provider: str, table: str, columns: tuple[str, ...], **more) -> Dialect:
    return Dialect(name, provider, family="sqlite", table=table, columns=columns, **more)


MESSAGE_COLUMNS = ("id", "session_id", "role", "content", "created_at", "timestamp", "time_created", "data", "type")

DIALECTS = {
    d.source_format: d
    for d in (
        _jsonl("cursor_agent_transcript_jsonl_tree", "cursor", kind=("event", "type"), content=("message.content", "message", "content", "text")),
        _jsonl("gemini_cli_chat_recording_jsonl", "gemini", kinds={"gemini": ("message", "assistant"), "user": ("message", "user"), "result": ("tool_output", "tool")}, skipped=("$set", "$rewindTo"), time=("timestamp", "startTime")),
        _jsonl("antigravity_cli_transcript_jsonl_tree", "antigravity", native_id=("step_index", "id"), content=("message.content", "content", "text", "thinking", "tool_calls"), kinds={"USER_INPUT": ("message", "user"), "CONVERSATION_HISTORY": ("message", "assistant"), "PLANNER_RESPONSE": ("message", "assistant"), "SYSTEM_MESSAGE": ("notice", "system"), "CODE_ACTION": ("tool_call", "assistant"), "CHECKPOINT": ("summary", "system")}, present=(("tool_calls", None, "tool_call"),), author="source", authors={"user": "user", "planner": "assistant", "agent": "assistant", "assistant": "assistant", "tool": "tool", "executor": "tool", "system": "system"}, other=("notice", "assistant")),
        _jsonl("tabnine_cli_chat_recording_jsonl", "tabnine", content=("message.content", "content", "text", "toolCalls", "$['$set']"), kinds={"tabnine": ("message", "assistant"), "gemini": ("message", "assistant"), "user": ("message", "user")}, present=(("$['$set']", None, "notice"), ("$['$rewindTo']", None, "notice"), ("toolCalls[*].result", None, "tool_output"), ("toolCalls", None, "tool_call")), phrases=(("$['$rewindTo']", "rewind to "),), other=("notice", "system"), time=("timestamp", "startTime")),
        _jsonl("qoder_transcript_jsonl", "qoder", content=("message.content", "data.content", "content"), kinds={"toolUseResult": ("tool_output", "tool")}),
        _jsonl("factory_ai_droid_sessions_jsonl", "factory_ai_droid", session=("sessionId", "callingSessionId"), parent=("parentId",), kinds={"compaction_state": ("summary", "system"), "session_start": ("notice", "system")}),
        _jsonl("copilot_cli_session_events_jsonl", "copilot_cli", session=("data.sessionId", "sessionId"), content=("data.content", "data.result.content", "data.error.message", "data.arguments"), kinds={"user.message": ("message", "user"), "assistant.message": ("message", "assistant"), "tool.execution_start": ("tool_call", "tool"), "tool.execution_complete": ("tool_output", "tool"), "session.start": ("notice", "system"), "session.truncation": ("summary", "system"), "abort": ("notice", "system")}, other=("notice", "system")),
        _jsonl("qwen_code_chat_jsonl", "qwen_code", native_id=("uuid", "id"), kinds={"tool_result": ("tool_output", "tool"), "system": ("notice", "system")}, present=(("message.content[*].type", "tool_use", "tool_call"), ("toolCallResult", None, "tool_output"))),
        _jsonl("grok_build_session_updates_jsonl", "grok_build", session=("params.sessionId", "sessionId"), native_id=("eventId", "params.update.toolCallId"), unique_id=("eventId",), kind=("params.update.sessionUpdate", "sessionUpdate"), time=("params._meta.agentTimestampMs", "timestamp"), content=("params.update.content", "params.update.rawOutput", "params.update.rawInput", "params.update.title"), kinds={"user_message_chunk": ("message", "user"), "agent_message_chunk": ("message", "assistant"), "tool_call": ("tool_call", "assistant"), "tool_call_update": ("tool_output", "tool")}),
        _jsonl("deepseek_harness_session_jsonl", "deepseek_harness", content=("data.content", "data.text", "data.arguments", "data.result"), kinds={"user/message": ("message", "user"), "assistant/message": ("message", "assistant"), "tool/call": ("tool_call", "assistant"), "tool/result": ("tool_output", "tool")}),
        _jsonl("pi_session_jsonl", "pi", kinds={"branch_summary": ("summary", "assistant"), "session_info": ("notice", "system"), "model_change": ("notice", "system"), "thinking_level_change": ("notice", "system"), "bashExecution": ("command_output", "tool")}, parent=("parentSession",)),
        _jsonl("junie_session_events_jsonl_tree", "junie", kind=("event.agentEvent.kind", "event.kind", "kind"), time=("timestampMs", "event.timestampMs"), content=("event.agentEvent.result", "event.agentEvent.text", "event.agentEvent.message", "event.prompt", "prompt", "text"), kinds={"UserPromptEvent": ("message", "user"), "ResultBlockUpdatedEvent": ("message", "assistant"), "AgentFailureEvent": ("notice", "system"), "FileChangesBlockUpdatedEvent": ("artifact", "assistant"), "CurrentDirectoryUpdatedEvent": ("notice", "system")}, skipped=("LlmResponseMetadataEvent",)),
        _jsonl("openclaw_session_jsonl_tree", "openclaw", parent=("parentSessionId", "parent_session_id", "spawnedBy")),
        _jsonl("kimi_code_cli_wire_jsonl", "kimi_code_cli", time=("timestamp", "created_at", "time"), role=("event.role", "message.role", "role"), content=("event.text", "event.content", "event.message", "event.part", "event.output", "message.content", "input", "text"), kinds={"context.append_message": ("message", None), "turn.steer": ("message", "user"), "full_compaction.complete": ("summary", "system")}, skipped=("usage.record", "permission.set_mode", "tools.set_active_tools")),
        _jsonl("mistral_vibe_session_jsonl", "mistral_vibe", native_id=("message_id", "id"), role=("role",), kind=("kind",)),
        _jsonl("mux_session_jsonl", "mux", session=("workspaceId", "sessionId"), parent=("parentWorkspaceId", "parentTaskId", "parentSessionId"), root=("rootWorkspaceId", "rootTaskId", "rootSessionId"), time=("metadata.timestamp", "timestamp", "createdAt"), content=("parts", "content", "text"), role=("role",)),
        _sqlite("opencode_sqlite", "opencode", "message", MESSAGE_COLUMNS, session=("session_id", "data.sessionID"), role=("role", "data.role"), content=("content", "data.parts", "data.content", "data.text"), time=("created_at", "time_created", "data.time.created")),
        _sqlite("kilo_sqlite", "kilo", "message", MESSAGE_COLUMNS, session=("session_id", "data.sessionID"), role=("role", "data.role"), content=("content", "data.parts", "data.content", "data.text"), time=("created_at", "time_created", "data.time.created")),
        _sqlite("mimocode_sqlite", "mimocode", "message", MESSAGE_COLUMNS, session=("session_id", "data.sessionID"), role=("role", "data.role"), content=("content", "data.parts", "data.content", "data.text"), time=("created_at", "time_created", "data.time.created")),
        _sqlite("deepagents_sessions_sqlite", "deepagents", "checkpoints", ("thread_id", "checkpoint_id", "parent_checkpoint_id", "type", "checkpoint", "metadata"), session=("thread_id",), native_id=("checkpoint_id",), content=("checkpoint.channel_values.messages", "metadata.writes")),
        _sqlite("forgecode_sqlite", "forgecode", "conversations", ("conversation_id", "title", "context", "created_at", "updated_at"), session=("conversation_id",), native_id=("conversation_id",), content=("context.messages", "context")),
        _sqlite("zed_threads_sqlite", "zed", "threads", ("id", "summary", "updated_at", "data_type", "data"), session=("id",), content=("data.messages", "summary"), time=("updated_at",)),
        _sqlite("firebender_chat_history_sqlite", "firebender", "messages", ("id", "session_id", "role", "content", "created_at")),
        _sqlite("goose_sessions_sqlite", "goose", "messages", ("id", "session_id", "role", "content_json", "created_timestamp", "timestamp"), content=("content_json",), time=("created_timestamp", "timestamp")),
        _sqlite("kiro_cli_sqlite", "kiro_cli", "conversations", ("key", "value", "created_at"), session=("key",), native_id=("key",), content=("value.transcript", "value.history", "value")),
        _sqlite("warp_sqlite", "warp", "agent_conversations", ("id", "conversation_id", "conversation_data", "last_modified_at"), session=("conversation_id",), content=("conversation_data",), time=("last_modified_at",)),
        _sqlite("astrbot_data_v4_sqlite", "astrbot", "platform_message_history", ("id", "platform_id", "user_id", "sender_id", "content", "created_at"), session=("user_id", "platform_id"), content=("content.message", "content"), role=("sender_id",)),
        _sqlite("crush_sqlite", "crush", "messages", ("id", "session_id", "role", "parts", "model", "created_at", "updated_at"), content=("parts",)),
        _sqlite("lingma_sqlite", "lingma", "chat_record", ("request_id", "session_id", "question", "answer", "gmt_create"), native_id=("request_id",), content=("question", "answer"), time=("gmt_create",)),
        _sqlite("shelley_sqlite", "shelley", "messages", ("message_id", "conversation_id", "type", "llm_data", "user_data", "created_at"), session=("conversation_id",), native_id=("message_id",), content=("llm_data.Content", "user_data")),
        _sqlite("hermes_state_sqlite", "hermes", "messages", ("id", "session_id", "role", "content", "tool_calls", "timestamp")),
        _sqlite("openclaw_sqlite", "openclaw", "messages", ("id", "session_id", "role", "content", "created_at")),
        Dialect("auggie_session_json", "auggie", family="json", session=("sessionId", "id"), content=("exchange.request_message", "message", "content")),
        Dialect("openhands_event_files", "openhands", family="json", session=("session_id", "conversation_id"), kind=("action", "observation"), role=("source",), content=("message", "content", "args.content", "args.command")),
        Dialect("nanoclaw_project", "nanoclaw", family="json"),
        Dialect("cline_task_directory_json", "cline", family="json", time=("ts", "timestamp")),
        Dialect("roo_task_directory_json", "roo", family="json", time=("ts", "timestamp")),
        Dialect("cline_sdk_session_store", "cline", family="json"),
        Dialect("codebuddy_history_json", "codebuddy", family="json"),
        Dialect("continue_cli_sessions_json", "continue_cli", family="json", role=("message.role", "role"), content=("message.content", "content")),
        Dialect("rovodev_session_json_tree", "rovodev", family="json", kind=("kind", "part_kind"), content=("parts", "content")),
    )
}


def _ids(rows: DataFrame, dialect_format: str, provider: str) -> DataFrame:
    """Stable ids, the source key and the search order of projected rows."""
    session = F.coalesce("session_key", "file")
    # An event is known by the format's own id, else by its place; equal places in
    # two files of a session are two events.
    place = F.concat_ws(":", F.lit("at"), "file", F.col("offset").cast("string"))
    own = F.concat_ws(":", F.lit("id"), "own_id", "event_type") if "own_id" in rows.columns else None
    known_as = place if own is None else F.when(F.coalesce("own_id", F.lit("")) == "", place).otherwise(own)
    tag = digest(F.lit(provider), F.lit(dialect_format), session)
    parent = lambda c: F.when(F.col(c).isNotNull(), uuid8(digest(F.lit(provider), F.lit(dialect_format), F.col(c))))
    return conform(
        rows.withColumn("source_key", _source_key(provider, F.col("file")))
        .withColumn("provider", F.lit(provider))
        .withColumn("source_format", F.lit(dialect_format))
        .withColumn("session_id", uuid8(tag))
        .withColumn("parent_session_id", parent("parent_key"))
        .withColumn("root_session_id", parent("root_key"))
        .withColumn("provider_session_id", F.col("session_key"))
        .withColumn("event_digest", digest(F.lit(provider), F.lit(dialect_format), session, known_as, F.col("part").cast("string")))
        .withColumn("event_id", uuid8(F.col("event_digest")))
        # a line has fewer parts than bytes, so those of one never reach the next
        .withColumn("event_sequence", F.col("offset") * 64 + F.col("part"))
        .withColumn("policy_status", F.lit("selected"))
    )


def project(records: DataFrame, dialect: Dialect) -> DataFrame:
    """Events of a dialect's records; records without text are left out."""
    v = F.col("value")
    kind = at(v, *dialect.kind)
    role_text = first_text(v, *dialect.role)
    message = F.coalesce(F.when(F.startswith(F.ltrim(at(v, *dialect.message)), F.lit("{")), at(v, *dialect.message)), v)
    said = [F.concat(F.lit(words), at(v, path)) for path, words in dialect.phrases]
    body = F.coalesce(*[F.nullif(x, F.lit("")) for x in (value_text(at(v, *dialect.content)), *said)], block_text(message))
    type_by_kind, role_by_kind = (F.lit(None if dialect.other is None else x).cast("string") for x in dialect.other or (None, None))
    for name, (event, who) in dialect.kinds.items():
        type_by_kind = F.when(kind == name, event).otherwise(type_by_kind)
        role_by_kind = F.when(kind == name, who).otherwise(role_by_kind)
    for path, needle, event in reversed(dialect.present):
        held = at(v, path)
        type_by_kind = F.when(held.isNotNull() if needle is None else held.contains(needle), event).otherwise(type_by_kind)
    if dialect.author is not None:
        author = first_text(v, dialect.author)
        for name, who in dialect.authors.items():
            role_by_kind = F.when(author == name, who).otherwise(role_by_kind)
    rows = records.filter(~F.coalesce(kind.isin(*dialect.skipped), F.lit(False))) if dialect.skipped else records
    unique = dialect.native_id if dialect.unique_id is None else dialect.unique_id
    projected = rows.select(
        "file",
        "offset",
        F.lit(0).alias("part"),
        first_text(v, *dialect.session).alias("session_key"),
        first_text(v, *dialect.parent).alias("parent_key"),
        first_text(v, *dialect.root).alias("root_key"),
        (first_text(v, *unique) if unique else F.lit(None).cast("string")).alias("own_id"),
        F.coalesce(first_text(v, *dialect.native_id), message_id(message, F.col("offset"))).alias("native_event_id"),
        first_ms(*[at(v, p) for p in dialect.time]).alias("occurred_at_ms"),
        F.coalesce(type_by_kind, event_type(message, role_text)).alias("event_type"),
        F.coalesce(role_by_kind, role(role_text)).alias("role"),
        body.alias("body"),
        literal_facts(v, dialect.facts).alias("facts"),
    ).filter(F.trim("body") != "")
    return _ids(projected, dialect.source_format, dialect.provider)


def project_codex(records: DataFrame) -> DataFrame:
    """Envelopes of kind and payload; lines of other kinds are dropped before they are parsed."""
    v = F.col("value")
    wanted = ("response_item", "compacted", "session_meta", "turn_context", "event_msg")
    lines = records.filter(F.lit(False) | v.contains(wanted[0]) | v.contains(wanted[1]) | v.contains(wanted[2]) | v.contains(wanted[3]) | v.contains(wanted[4]))
    p = at(v, "payload")
    kind, item = at(v, "type"), at(v, "payload.type")
    said = F.when(at(p, "role").isin("developer", "system"), "system").when(at(p, "role").isin("user", "assistant"), at(p, "role"))
    message = (kind == "response_item") & (item == "message") & said.isNotNull()
    reasoning = (kind == "response_item") & (item == "reasoning")
    call = (kind == "response_item") & item.isin("function_call", "custom_tool_call", "web_search_call", "tool_search_call")
    result = ((kind == "response_item") & item.isin("function_call_output", "custom_tool_call_output", "tool_search_output", "tool_output", "tool_result")) | (
        (kind == "event_msg") & item.isin("patch_apply_end", "web_search_end", "exec_command_end", "command_complete", "tool_complete", "mcp_tool_call_end")
    )
    event = F.when(message, "message").when(reasoning | (kind == "compacted"), "summary").when(call, "tool_call").when(result, "tool_output")
    who = F.when(message, said).when(reasoning | call, "assistant").when(kind == "compacted", "system").when(result, "tool")
    text = (
        F.when(message, value_text(at(p, "content")))
        .when(reasoning, F.coalesce(value_text(at(p, "summary")), at(p, "summary_text")))
        .when(kind == "compacted", F.coalesce(at(p, "message"), block_text(p)))
        .when(call, p)
        .when(result, value_text(at(p, "output", "result", "content", "aggregated_output")))
    )
    meta = lines.filter(kind == "session_meta").groupBy("file").agg(
        F.min_by(at(p, "id"), "offset").alias("session_key"),
        F.min_by(F.coalesce(at(p, "parent_thread_id"), at(p, "forked_from_id")), "offset").alias("parent_key"),
    )
    hidden = reasoning & at(p, "encrypted_content").isNotNull() & F.coalesce(F.trim(text) == "", F.lit(True))
    rows = lines.filter(event.isNotNull() & ~hidden).select(
        "file",
        "offset",
        F.lit(0).alias("part"),
        at(p, "id").alias("native_event_id"),
        at(p, "call_id").alias("call_id"),
        first_ms(at(v, "timestamp")).alias("occurred_at_ms"),
        event.alias("event_type"),
        who.alias("role"),
        F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.concat_ws(" ", event, who)).alias("body"),
        literal_facts(F.coalesce(at(p, "arguments"), p), COMMON_FACTS).alias("facts"),
    )
    joined = rows.join(meta, "file", "left").withColumn("root_key", F.lit(None).cast("string"))
    return _ids(joined, "codex_session_jsonl", "codex")


def project_claude(records: DataFrame) -> DataFrame:
    """A line becomes its text row and a row for each tool call; thinking never stays."""
    v = F.col("value")
    entry = F.coalesce(at(v, "type"), F.lit("unknown"))
    content = at(v, "message.content", "content")
    blocks = F.coalesce(elements(content), F.array().cast("array<string>"))
    texts = F.transform(F.filter(blocks, lambda b: (at(b, "type") == "text") & (F.trim(at(b, "text")) != "")), lambda b: at(b, "text"))
    calls = F.filter(blocks, lambda b: at(b, "type").isin("tool_use", "server_tool_use"))
    kind = F.when(entry.isin("user", "assistant"), "message").when(entry.isin("summary", "compact_boundary"), "summary").otherwise("notice")
    plain = F.when(elements(content).isNull(), content)
    found = F.coalesce(F.when(F.trim(plain) != "", plain), F.when(F.size(texts) > 0, F.array_join(texts, "\n")), F.nullif(F.trim(at(v, "summary")), F.lit("")))
    body = F.coalesce(found, F.when((F.size(calls) == 0) & (kind == "notice"), F.concat(F.lit("Claude event: "), entry)))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    text_row = F.struct(kind.alias("event_type"), body.alias("body"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("arguments"), none.alias("facts"))
    call_rows = F.transform(
        calls,
        lambda b: F.struct(F.lit("tool_call").alias("event_type"), b.alias("body"), at(b, "id").alias("call_id"), at(b, "name").alias("tool"), at(b, "input", "arguments", "args").alias("arguments"), literal_facts(at(b, "input", "arguments", "args"), CLAUDE_FACTS).alias("facts")),
    )
    rows = records.select(
        "file",
        "offset",
        first_text(v, "sessionId").alias("session_key"),
        F.lit(None).cast("string").alias("parent_key"),
        F.lit(None).cast("string").alias("root_key"),
        first_text(v, "uuid").alias("own_id"),
        first_text(v, "uuid", "message.id").alias("native_event_id"),
        first_ms(at(v, "timestamp")).alias("occurred_at_ms"),
        role(F.coalesce(at(v, "message.role"), at(v, "role"), entry)).alias("role"),
        F.posexplode(F.concat(F.filter(F.array(text_row), lambda t: t["body"].isNotNull()), call_rows)).alias("part", "e"),
    ).select("file", "offset", "part", "session_key", "parent_key", "root_key", "own_id", "native_event_id", "occurred_at_ms", "role", "e.*")
    return _ids(rows, "claude_projects_jsonl_tree", "claude")


def project_prompt_history(records: DataFrame) -> DataFrame:
    """Prompt history: a session id, seconds and the text a user typed."""
    v = F.col("value")
    rows = records.select("file", "offset", F.lit(0).alias("part"), at(v, "session_id").alias("session_key"), F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("string").alias("root_key"), first_ms(at(v, "ts")).alias("occurred_at_ms"), F.lit("message").alias("event_type"), F.lit("user").alias("role"), at(v, "text").alias("body"))
    return _ids(rows.filter(F.trim("body") != ""), "codex_history_jsonl", "codex")


def sqlite_records(table: DataFrame) -> DataFrame:
    """Rows of ``sources.sqlite.read_table`` as records of JSON."""
    columns = [c for c in table.columns if c not in ("database", "row_number")]
    # Columns that hold JSON stay JSON: paths go into them.
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.to_json(F.struct(F.lit(c).alias("k"))).substr(F.lit(6), F.lit(len(c) + 2)), F.lit(":"), _json_value(F.col(c)))) for c in columns]
    return table.select(F.col("database").alias("file"), F.col("row_number").alias("offset"), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


#: Events of agent databases: a line of the session's active transcript, the event it names, and that event's identity.
OPENCLAW_AGENT = Dialect("openclaw_agent_sqlite", "openclaw", session=("sessionId",), native_id=("id",), time=("timestamp", "event.timestamp"), kind=("event.type",), role=("event.message.role", "event.role", "event.type"), content=("event.message.content", "event.content", "event.text"), message=("event.message", "event"), parent=("parentId",))


def openclaw_agent_events(spark, path: str, suffix: str = ".db") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of agent databases: active transcripts joined with their events, identities and sessions.

    The tables are joined inside each database. A line of a transcript whose event has no
    identity, or more than one, is rejected: (file, offset, reason).
    """
    joins = [
        Joined("transcript_events", (("session_id", "session_id"), ("seq", "event_seq")), {"event_json": "event_json", "created_at": "created_at"}, True),
        Joined("transcript_event_identities", (("session_id", "session_id"), ("seq", "event_seq")), {"identity": "event_id"}),
        Joined("sessions", (("session_id", "session_id"),), {"parent_id": "parent_session_id"}),
    ]
    rows = read_joined(spark, path, "session_transcript_active_events", {"session_id": "session_id", "position": "active_position", "event_seq": "event_seq"}, joins, suffix)
    lines = rows.groupBy("database", "session_id", F.col("position").cast("long").alias("position"), "event_seq").agg(
        F.count("identity").alias("identities"), F.min("identity").alias("identity"), F.min("event_json").alias("event_json"), F.min("created_at").alias("created_at"), F.min("parent_id").alias("parent_id"), F.min("row_number").alias("offset")
    )
    reason = F.when(F.col("identities") != 1, F.concat(F.col("identities").cast("string"), F.lit(" identities"))).when(F.try_parse_json("event_json").isNull(), "malformed")
    judged = lines.withColumn("reason", reason)
    quoted = lambda c: F.to_json(F.array(F.col(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2)
    value = F.concat(F.lit('{"sessionId":'), quoted("session_id"), F.lit(',"id":'), quoted("identity"), F.lit(',"timestamp":'), quoted("created_at"), F.when(F.col("parent_id").isNotNull(), F.concat(F.lit(',"parentId":'), quoted("parent_id"))).otherwise(""), F.lit(',"event":'), F.col("event_json"), F.lit("}"))
    good = judged.filter("reason IS NULL").select(F.col("database").alias("file"), F.col("position").alias("offset"), value.alias("value"))
    rejects = judged.filter("reason IS NOT NULL").select(F.col("database").alias("file"), "offset", "reason")
    return project(good, OPENCLAW_AGENT), rejects


def _json_value(text: Column) -> Column:
    quoted = F.to_json(F.struct(text.alias("v")))
    nested = F.ltrim(text)
    looks = F.startswith(nested, F.lit("{")) | F.startswith(nested, F.lit("["))
    return F.when(looks & F.try_parse_json(text).isNotNull(), text).otherwise(quoted.substr(F.lit(6), F.length(quoted) - 6))


def document_records(files: DataFrame, list_path: str | None = None) -> DataFrame:
    """Elements of JSON documents (path, content) as records, numbered in order.

    A document is a list, or an object with its events below ``list_path``, or
    one event by itself.
    """
    text = F.col("content").cast("string")
    found = at(text, list_path) if list_path else text
    items = F.coalesce(elements(found), F.array(text))
    return files.select(F.col("path").alias("file"), F.posexplode(items).alias("offset", "value")).select("file", F.col("offset").cast("long").alias("offset"), "value")


def _source_key(provider: str, file: Column) -> Column:
    return F.concat_ws("/", F.lit(provider), file)


def source_key(source_format: str) -> Callable[[Column], Column]:
    """The source that a file of a format makes."""
    own = {"codex_session_jsonl": "codex", "claude_projects_jsonl_tree": "claude", "codex_history_jsonl": "codex"}
    provider = own.get(source_format) or DIALECTS[source_format].provider
    return lambda file: _source_key(provider, file)


def project_format(records: DataFrame, source_format: str) -> DataFrame:
    """Events of any known format."""
    own = {"codex_session_jsonl": project_codex, "claude_projects_jsonl_tree": project_claude, "codex_history_jsonl": project_prompt_history}
    if source_format in own:
        return own[source_format](records)
    if source_format not in DIALECTS:
        raise ValueError(f"unknown source format {source_format!r}")
    return project(records, DIALECTS[source_format])


FORMATS = tuple(sorted([*DIALECTS, "codex_session_jsonl", "claude_projects_jsonl_tree", "codex_history_jsonl"]))
