"""Text, roles and kinds out of provider JSON, as column expressions.

JSON values are strings of JSON; a missing value is null. Nested lists inside
lists are rare in transcripts: text is taken from blocks and from the blocks of
a tool result, two levels as the formats have them.
"""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL_KINDS = ("tool_use", "tool-use", "tool_call", "tool-call", "function_call", "toolCall", "tool", "agent")
RESULT_KINDS = ("tool_result", "tool-result", "tool_use_result", "function_result")
FILE_KEYS = ("file", "files", "filename", "filepath", "filepaths", "path", "paths", "oldpath", "newpath", "sourcepath", "targetpath", "absolutepath", "relativepath", "notebookpath", "filelist")
URL_KEYS = ("url", "uri")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row and named, not repeated,
    in the expression: nested uses would otherwise multiply its size."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(value: Column, *paths: str) -> Column:
    """First path that holds something; objects and lists come as JSON."""
    found = [F.get_json_object(value, p if p.startswith("$") else f"$.{p}") for p in paths]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def first_text(value: Column, *paths: str) -> Column:
    """First field that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(at(value, p)), F.lit("")) for p in paths])


def elements(value: Column) -> Column:
    """Elements of a JSON list, each as JSON or plain text; null if it is none."""
    return F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>"))


def _block(block: Column) -> Column:
    def label(kind: Column) -> Column:
        name = F.coalesce(at(block, "name", "tool", "tool_name", "toolName"), F.lit("tool"))
        return F.when(kind.isin(*CALL_KINDS), F.concat(F.lit("tool call: "), name)).when(kind.isin(*RESULT_KINDS), F.lit("tool result"))

    def said(text: Column) -> Column:
        joined = lambda inner: F.nullif(F.array_join(F.array_compact(F.transform(inner, lambda b: at(b, "text", "content"))), "\n"), F.lit(""))
        return let(elements(text), lambda inner: F.when(inner.isNull(), text).otherwise(joined(inner)))

    found = F.coalesce(let(at(block, "text", "content", "output", "summary"), said), let(at(block, "type", "kind"), label))
    return F.when(F.startswith(F.ltrim(block), F.lit("{")), found).otherwise(block)


def value_text(value: Column) -> Column:
    """Text of a value: itself, its blocks line by line, or its JSON."""

    def text(v: Column) -> Column:
        joined = lambda blocks: F.nullif(F.array_join(F.array_compact(F.transform(blocks, _block)), "\n"), F.lit(""))
        listed = let(elements(v), lambda blocks: F.when(blocks.isNotNull(), joined(blocks)).otherwise(v))
        return F.when(v.isNull() | (v == "null"), F.lit(None)).otherwise(listed)

    return let(value, text)


def block_text(value: Column) -> Column:
    """Text of a message by the usual fields, the first one that isn't blank."""
    fields = ("text", "content", "message", "prompt", "response", "output", "summary")

    def first(v: Column) -> Column:
        texts = [let(value_text(at(v, f)), lambda t: F.when(F.trim(t) != "", t)) for f in fields]
        return F.coalesce(*texts, value_text(at(v, "parts", "blocks")))

    return let(value, first)


def role(text: Column) -> Column:
    """One of the closed set of roles."""
    return let(
        text,
        lambda t: F.when(t.isin("user", "human", "user_prompt", "user-prompt"), "user")
        .when(t.isin("assistant", "agent", "ai", "model"), "assistant")
        .when(t.isin("system", "developer", "system_prompt", "system-prompt"), "system")
        .when(t.isin("tool", "tool_result", "tool-result", "tool_use_result"), "tool")
        .otherwise("unknown"),
    )


def event_type(value: Column, role_text: Column) -> Column:
    """tool_output, tool_call, notice or message, from the role and the blocks."""

    def of(r: Column, kinds: Column) -> Column:
        has = lambda *wanted: F.arrays_overlap(kinds, F.array(*[F.lit(w) for w in wanted]))
        return (
            F.when(r.contains("tool_result") | r.contains("tool-result") | has("tool_result", "tool-result"), "tool_output")
            .when(r.contains("tool_use") | r.contains("tool-use") | has("tool_use", "tool-use", "tool-call", "tool_call"), "tool_call")
            .when(r.isin("system", "developer", "system_prompt", "system-prompt"), "notice")
            .otherwise("message")
        )

    parts = F.coalesce(elements(at(value, "parts", "content", "blocks")), F.array().cast("array<string>"))
    kinds = F.array_compact(F.transform(parts, lambda p: at(p, "type", "kind")))
    return let(F.coalesce(role_text, F.lit("")), lambda r: let(kinds, lambda k: of(r, k)))


def message_id(value: Column, fallback: Column) -> Column:
    return F.coalesce(first_text(value, "id", "uuid", "message_id", "messageId"), F.concat(F.lit("message-"), fallback.cast("string")))


def capped(text: Column, limit: int) -> Column:
    """(text, truncated) of at most ``limit`` characters."""
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"))


def json_or_text(raw: Column) -> Column:
    """The raw JSON, or the raw text as a JSON string where it isn't JSON."""
    return F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(F.to_json(raw_struct := F.struct(raw.alias("v"))).substr(F.lit(6), F.length(F.to_json(raw_struct)) - 6))


def literal_facts(value: Column, keys: dict[str, str]) -> Column:
    """Facts of the known keys of an object, in the order of ``keys``."""
    found = [F.struct(F.lit(kind).alias("kind"), at(value, key).alias("value")) for key, kind in keys.items()]
    return F.filter(F.array(*found), lambda f: f["value"].isNotNull() & (f["value"] != ""))


def _walk(node, out: list[tuple[str, str]]) -> None:
    if isinstance(node, dict):
        for key, value in node.items():
            plain = re.sub("[^a-z0-9]", "", key.lower())
            kind = "file" if plain in FILE_KEYS else "url" if plain in URL_KEYS else None
            values = value if isinstance(value, list) else [value]
            if kind:
                out += [(kind, v) for v in values if isinstance(v, str) and v.strip()]
            _walk(value, out)
    elif isinstance(node, list):
        for value in node:
            _walk(value, out)


def references(text: str | None) -> list[tuple[str, str]]:
    """File and URL values at any depth of a JSON text, in order."""
    try:
        node = json.loads(text) if text else None
    except ValueError:
        return []
    out: list[tuple[str, str]] = []
    _walk(node, out)
    return out


def command_words(text: str | None) -> list[str] | None:
    """Words of a command line; None where a shell would compose commands."""
    if not text or re.search(r"[;&|<>`\n]|\$\(", text):
        return None
    try:
        return shlex.split(text)
    except ValueError:
        return None


def with_references(rows: DataFrame, column: str) -> DataFrame:
    """Add ``references``: file and URL facts at any depth of a JSON column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(references=[[{"kind": k, "value": v} for k, v in references(x if isinstance(x, str) else None)] for x in pdf[column]])

    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{listed}, references array<struct<kind:string,value:string>>")


MAX_MEMBERS = 65536


def _keys_are_unique(text: str | None) -> bool:
    members = 0

    def pairs(found: list) -> None:
        nonlocal members
        members += len(found)
        if members > MAX_MEMBERS or len({k for k, _ in found}) < len(found):
            raise ValueError

    def constant(name: str) -> None:
        raise ValueError(name)

    try:
        json.loads(text or "", object_pairs_hook=pairs, parse_constant=constant)
    except (ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def keys_are_unique(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON value without repeated keys at any depth.

    The JVM's parsers keep the last of equal keys and don't tell. False for
    null, malformed or too deep texts and beyond ``MAX_MEMBERS`` members.
    """
    return texts.map(_keys_are_unique).astype(bool)


def only_alias(value: Column, names: list[str], max_bytes: int = 4096) -> Column:
    """(state, text) of the one key among ``names``: missing, exact or ambiguous.

    Two of them are ambiguous even when they agree, as are empty, long or other values.
    """
    typed = F.from_json(value, "map<string,string>")
    texts = F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(F.map_contains_key(typed, n).alias("there"), F.element_at(typed, n).alias("text"))), lambda x: x["there"])
    return let(
        texts,
        lambda f: F.when(F.size(f) < 1, F.struct(F.lit("missing").alias("state"), F.lit(None).cast("string").alias("text")))
        .when((F.size(f) == 1) & F.octet_length(F.get(f, F.lit(0))["text"]).between(1, max_bytes), F.struct(F.lit("exact").alias("state"), F.get(f, F.lit(0))["text"].alias("text")))
        .otherwise(F.struct(F.lit("ambiguous").alias("state"), F.lit(None).cast("string").alias("text"))),
    )
