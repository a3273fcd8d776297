"""Typed filters over events; all of them are one Catalyst predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import folded_contains
from ..schema import AGENT_SCOPES, CONTENT_SCOPES

WORKSPACE_KINDS = ("workspace", "session_cwd", "tool_workdir", "project")
CONTROL_PREFIXES = ("<command-name>", "<command-message>", "<local-command-stdout>", "Caveat:")
MAX_FILTER_BYTES = 4096


def filter_text(value: str, what: str = "filter") -> str:
    """Trimmed filter text; empty and oversized ones are errors."""
    text = value.strip()
    if not text:
        raise ValueError(f"{what} is empty")
    if len(text.encode()) > MAX_FILTER_BYTES:
        raise ValueError(f"{what} is longer than {MAX_FILTER_BYTES} bytes")
    return text


def has_fact(kinds: tuple[str, ...], test) -> Column:
    """Whether any fact of one of ``kinds`` passes ``test``."""
    wanted = F.array(*[F.lit(k) for k in kinds])
    return F.coalesce(F.exists("facts", lambda f: F.array_contains(wanted, f["kind"]) & test(f["value"])), F.lit(False))


def not_in(column: str, values: list[str]) -> Column:
    """Null-safe NOT IN: a null isn't in any list."""
    return ~F.coalesce(F.col(column).isin(values), F.lit(False))


def outside_tree(sessions: list[str], provider: str | None = None, provider_session: str | None = None) -> Column:
    """Rows outside a session tree; null parents and roots never drop a row."""
    inside = [F.col(c).isin(sessions) for c in ("session_id", "parent_session_id", "root_session_id")] if sessions else []
    if provider is not None and provider_session is not None:
        inside.append((F.col("provider") == provider) & (F.col("provider_session_id") == provider_session))
    return ~reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in inside], F.lit(False))


def custom_source(identity: str) -> Column:
    """``key/id`` of a custom source; malformed text matches nothing."""
    parts = identity.split("/")
    if len(parts) != 2 or not all(p.strip() for p in parts):
        return F.lit(False)
    return (F.col("provider") == "custom") & (F.col("custom_provider_key") == parts[0].strip()) & (F.col("custom_source_id") == parts[1].strip())


def semantic_candidate() -> Column:
    """User messages that may be embedded: discoverable and not copied."""
    return (
        (F.col("event_type") == "message")
        & (F.col("role") == "user")
        & discovery_eligible()
        & F.col("copy_ancestor_event_id").isNull()
        & ~reduce(lambda a, b: a | b, [F.startswith(F.ltrim(F.coalesce("body", F.lit(""))), F.lit(p)) for p in CONTROL_PREFIXES])
    )


def discovery_eligible() -> Column:
    return (F.coalesce("policy_status", F.lit("selected")) == "selected") & F.col("discovery_exclusion").isNull()


@dataclass
class EventFilters:
    """Conjunction of the filters that are set; they never change a score."""

    discoverable: bool = False
    provider: str | None = None
    providers: list[str] = field(default_factory=list)
    source_format: str | None = None
    provider_session_id: str | None = None
    session_id: str | None = None
    parent_session_id: str | None = None
    root_session_id: str | None = None
    excluded_sessions: list[str] = field(default_factory=list)
    branch: str | None = None
    event_type: str | None = None
    role: str | None = None
    content_scope: str = "all"
    workspace: str | None = None
    file: str | None = None
    since_ms: int | None = None
    until_ms: int | None = None
    agent_scope: str | None = None
    custom_source: str | None = None
    source_key: str | None = None

    def canonical(self) -> EventFilters:
        """The same selection, written in one way: for cursors and digests."""
        values = dict(self.__dict__)
        values["providers"] = sorted(set(self.providers))
        values["excluded_sessions"] = sorted(set(self.excluded_sessions))
        for name in ("workspace", "file"):
            if values[name] is not None:
                values[name] = filter_text(values[name], name).lower()
        return EventFilters(**values)

    def validated(self) -> EventFilters:
        if self.content_scope not in CONTENT_SCOPES:
            raise ValueError(f"unknown content scope {self.content_scope!r}")
        allowed = CONTENT_SCOPES[self.content_scope]
        if allowed and self.event_type is not None and self.event_type not in allowed:
            raise ValueError(f"event type {self.event_type!r} is outside scope {self.content_scope!r}")
        if self.agent_scope is not None and self.agent_scope not in AGENT_SCOPES:
            raise ValueError(f"unknown agent scope {self.agent_scope!r}")
        if self.until_ms is not None and (self.since_ms is None or self.until_ms <= self.since_ms):
            raise ValueError("a range needs both bounds, in order")
        for name in ("provider", "source_format", "provider_session_id", "branch", "event_type", "role", "workspace", "file"):
            if getattr(self, name) is not None:
                filter_text(getattr(self, name), name)
        return self

    def column(self) -> Column:
        self.validated()
        tests: list[Column] = []
        if self.discoverable:
            tests.append(discovery_eligible())
        for name in ("provider", "source_format", "provider_session_id", "session_id", "parent_session_id", "root_session_id", "event_type", "role", "agent_scope"):
            value = getattr(self, name)
            if value is not None:
                tests.append(F.col(name) == value.strip())
        if self.providers:
            tests.append(F.col("provider").isin(sorted(set(self.providers))))
        if self.excluded_sessions:
            tests.append(not_in("session_id", self.excluded_sessions))
        if self.branch is not None:
            tests.append(has_fact(("branch",), lambda v: v == self.branch))
        if CONTENT_SCOPES[self.content_scope]:
            tests.append(F.col("event_type").isin(*CONTENT_SCOPES[self.content_scope]))
        if self.workspace is not None:
            tests.append(has_fact(WORKSPACE_KINDS, lambda v: folded_contains(v, filter_text(self.workspace))))
        if self.file is not None:
            tests.append(has_fact(("file",), lambda v: folded_contains(v, filter_text(self.file))))
        if self.since_ms is not None:
            tests.append(F.col("occurred_at_ms") >= self.since_ms)
        if self.until_ms is not None:
            tests.append(F.col("occurred_at_ms") < self.until_ms)
        if self.custom_source is not None:
            tests.append(custom_source(self.custom_source))
        if self.source_key is not None:
            tests.append(F.col("source_key") == self.source_key)  # exact: keys aren't trimmed
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def id_prefix(prefix: str, column: str = "event_id") -> Column:
    """Events whose id begins with at least eight hex digits, dashes left out."""
    text = prefix.strip().lower()
    if not re.fullmatch("[0-9a-f]{8,32}", text):
        raise ValueError("an id prefix has 8 to 32 hex digits and no dashes")
    return F.startswith(F.replace(F.lower(F.col(column)), F.lit("-"), F.lit("")), F.lit(text))
