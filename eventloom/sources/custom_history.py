"""The line format for histories of other tools: parse, validate, relate.

Records are manifest, source, session, event, file_reference and edge. Relations
are joins; what fails one goes to the rejects with a reason, and everything
else goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import digest, uuid8
from ..functions.times import provider_ms
from ..schema import MAX_FACTS, conform

RECORD = (
    "record_type string, schema_version string, lineage_contract string, source_id string, provider_key string, source_format string, session_id string, "
    "native_session_id string, parent_session_id string, root_session_id string, session_relationship string, agent_scope string, event_index long, event_id string, "
    "copied_from struct<ancestor_native_session_id:string,ancestor_event_id:string,proof:string>, event_type string, role string, occurred_at string, payload string, "
    "preview string, reference_index long, value string, path string, touch_index long, from_session_id string, to_session_id string, edge_id string, relationship string"
)
RECORD_TYPES = ("manifest", "source", "session", "event", "file_reference", "file_touch", "edge")
DIRECT = ("delegated", "forked", "resumed_from", "workflow_child")
FORMAT = "custom_history_jsonl"  # this library's own name for it
BODY_FIELDS = ("text", "content", "message", "summary", "command")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of lines (file, offset, value)."""
    r = lines.withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}))
    known = F.coalesce(F.col("r.record_type").isin(*RECORD_TYPES), F.lit(False))
    records = r.filter(known).select("file", "offset", "r.*")
    return records, r.filter(~known).select("file", "offset", F.when(F.try_parse_json("value").isNull(), "malformed").otherwise("unknown record type").alias("reason"))


def _first(rows: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """The first line of each key, and the later ones as rejects."""
    w = Window.partitionBy(*key).orderBy("file", "offset")
    ranked = rows.withColumn("__nth", F.row_number().over(w))
    return ranked.filter("__nth = 1").drop("__nth"), _rejects(ranked.filter("__nth > 1"), "duplicate")


def _rejects(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select("file", "offset", F.lit(reason).alias("reason"))


def event_body(payload, event_type):
    """First text of the payload, else the payload itself, else the event's type."""
    texts = [F.nullif(F.trim(F.get_json_object(payload, f"$.{f}")), F.lit("")) for f in BODY_FIELDS]
    whole = F.when(~F.coalesce(F.trim(payload), F.lit("")).isin("", "{}", "null"), payload)
    return F.coalesce(*texts, whole, event_type)


def relate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events in the record schema, rejects) of parsed records."""
    bad: list[DataFrame] = []
    keep = lambda pair: (bad.append(pair[1]), pair[0])[1]
    manifest = records.filter("record_type = 'manifest'")
    lineage = manifest.agg(F.max("lineage_contract").alias("lineage_contract"))
    sources = keep(_first(records.filter("record_type = 'source'"), "source_id"))
    session_rows = keep(_first(records.filter("record_type = 'session'"), "source_id", "session_id"))
    known = sources.select("source_id", F.col("provider_key"), F.col("source_format").alias("declared_format"))
    bad.append(_rejects(session_rows.join(known, "source_id", "left_anti"), "session of an unknown source"))
    own_parent = F.coalesce(F.col("parent_session_id") == F.col("session_id"), F.lit(False))
    bad.append(_rejects(session_rows.join(known, "source_id", "left_semi").filter(own_parent), "session is its own parent"))
    sessions = session_rows.drop("provider_key").join(known, "source_id").filter(~own_parent).select(
        "source_id", "session_id", "native_session_id", "parent_session_id", "root_session_id", "session_relationship", "agent_scope", "provider_key", "declared_format"
    )
    # Edges: both ends known, no contradiction; the last one of a child sets its parent.
    edges = records.filter("record_type = 'edge'").select("file", "offset", "source_id", "from_session_id", "to_session_id", "relationship")
    ends = sessions.select("source_id", "session_id", "parent_session_id")
    checked = (
        edges.join(ends.select("source_id", F.col("session_id").alias("from_session_id"), F.lit(True).alias("from_known")), ["source_id", "from_session_id"], "left")
        .join(ends.select("source_id", F.col("session_id").alias("to_session_id"), F.lit(True).alias("to_known"), F.col("parent_session_id").alias("claimed")), ["source_id", "to_session_id"], "left")
        .withColumn(
            "reason",
            F.when(F.col("from_known").isNull(), "edge from an unknown session")
            .when(F.col("to_known").isNull(), "edge to an unknown session")
            .when(F.col("relationship").isNotNull() & (F.col("claimed") != F.col("from_session_id")), "edge contradicts the session's parent"),
        )
    )
    bad.append(checked.filter("reason IS NOT NULL").select("file", "offset", "reason"))
    parents = (
        checked.filter("reason IS NULL AND relationship IS NOT NULL")
        .groupBy("source_id", F.col("to_session_id").alias("session_id"))
        .agg(F.max_by(F.struct("from_session_id", "relationship"), F.struct("file", "offset")).alias("edge"))
    )
    sessions = (
        sessions.join(parents, ["source_id", "session_id"], "left")
        .withColumn("parent_session_id", F.coalesce("edge.from_session_id", "parent_session_id"))
        .withColumn("session_relationship", F.coalesce("edge.relationship", "session_relationship"))
        .drop("edge")
    )
    events = keep(_first(records.filter("record_type = 'event'"), "source_id", "session_id", "event_index"))
    bad.append(_rejects(events.join(sessions, ["source_id", "session_id"], "left_anti"), "event of an unknown session"))
    events = events.drop("native_session_id", "parent_session_id", "root_session_id", "session_relationship", "agent_scope", "provider_key", "lineage_contract").join(sessions, ["source_id", "session_id"]).crossJoin(F.broadcast(lineage))  # one row
    # File references: to an event that is there, values in their own order.
    refs = records.filter("record_type IN ('file_reference', 'file_touch')").select("file", "offset", "source_id", "session_id", "event_index", F.coalesce("reference_index", "touch_index").alias("nth"), F.coalesce("value", "path").alias("value"))
    there = events.select("source_id", "session_id", "event_index")
    bad.append(_rejects(refs.filter("event_index IS NULL"), "file reference without event_index"))
    bad.append(_rejects(refs.filter("event_index IS NOT NULL").join(there, ["source_id", "session_id", "event_index"], "left_anti"), "file reference to an unknown event"))
    files = (
        refs.join(there, ["source_id", "session_id", "event_index"], "left_semi")
        .groupBy("source_id", "session_id", "event_index")
        .agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("nth", "file", "offset", "value"))), 1, MAX_FACTS), lambda x: F.struct(F.lit("file").alias("kind"), x["value"].alias("value"))).alias("facts"))
    )
    events = events.join(files, ["source_id", "session_id", "event_index"], "left")
    events, lost = _copied(events)
    bad.append(lost)
    out = events.select(
        F.concat_ws("/", F.lit("custom"), "provider_key", "source_id").alias("source_key"),
        F.lit("custom").alias("provider"),
        F.coalesce("declared_format", F.lit(FORMAT)).alias("source_format"),
        F.col("provider_key").alias("custom_provider_key"),
        F.col("source_id").alias("custom_source_id"),
        digest(F.lit("event"), F.col("source_id"), F.col("session_id"), F.col("event_index").cast("string")).alias("event_digest"),
        uuid8(digest(F.lit("session"), F.col("source_id"), F.col("session_id"))).alias("session_id"),
        F.when(F.col("parent_session_id").isNotNull(), uuid8(digest(F.lit("session"), F.col("source_id"), F.col("parent_session_id")))).alias("parent_session_id"),
        F.when(F.col("root_session_id").isNotNull(), uuid8(digest(F.lit("session"), F.col("source_id"), F.col("root_session_id")))).alias("root_session_id"),
        "session_relationship",
        F.when(F.col("copied"), uuid8(digest(F.lit("session"), F.col("source_id"), F.col("parent_session_id")))).alias("copy_ancestor_session_id"),
        F.when(F.col("copied"), F.col("copied_from.ancestor_event_id")).alias("copy_ancestor_event_id"),
        F.when(F.col("copied"), F.col("copied_from.proof")).alias("copy_proof"),
        F.col("native_session_id").alias("provider_session_id"),
        F.col("event_id").alias("native_event_id"),
        F.col("event_index").alias("event_sequence"),
        provider_ms(F.col("occurred_at")).alias("occurred_at_ms"),
        "event_type",
        "role",
        "agent_scope",
        F.lit("selected").alias("policy_status"),
        event_body(F.col("payload"), F.col("event_type")).alias("body"),
        "facts",
    ).withColumn("event_id", uuid8(F.col("event_digest")))
    rejects = bad[0]
    for more in bad[1:]:
        rejects = rejects.unionByName(more)
    return conform(out), rejects


def _copied(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark events whose claim to be a copy holds; (events, rejected claims)."""
    ids = Window.partitionBy("source_id", "session_id", "event_id")
    natives = Window.partitionBy("source_id", "native_session_id")
    proof = F.coalesce((F.col("copied_from.proof") != "native_event_identity") | (F.col("event_id") == F.col("copied_from.ancestor_event_id")), F.lit(False))
    stable = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    holds = (
        stable(F.col("copied_from.ancestor_native_session_id"))
        & stable(F.col("copied_from.ancestor_event_id"))
        & stable(F.col("event_id"))
        & (F.count(F.lit(1)).over(ids) == 1)
        & stable(F.col("native_session_id"))
        & (F.min("session_id").over(natives) == F.max("session_id").over(natives))
        & F.col("parent_session_id").isNotNull()
        & F.coalesce(F.col("session_relationship").isin(*DIRECT), F.lit(False))
        & proof
    )
    asked = F.col("copied_from").isNotNull() & F.col("lineage_contract").isNotNull()
    marked = events.withColumn("copied", asked & holds)
    return marked, _rejects(marked.filter(asked & ~F.col("copied")), "copied_from isn't proven")


def load(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of the lines of one export; exactly one manifest is needed."""
    records, malformed = parse(lines)
    n = records.filter("record_type = 'manifest'").limit(2).count()
    if n != 1:
        raise ValueError("missing manifest" if n == 0 else "more than one manifest")
    events, rejects = relate(records)
    return events, malformed.unionByName(rejects)
