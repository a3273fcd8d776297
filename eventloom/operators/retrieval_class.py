"""Which events only repeat what a history search had returned.

Results of the engine's own searches, read back into a transcript, would be
found again by the next search. A call is ``derived`` if it is one direct
command (or served tool) of the engine that reads history, ``ordinary`` if it
runs the engine for something else, ``unknown`` otherwise. A result takes the
class of the call that it names, if it succeeded; a failed one is ordinary. Of
several contributions one ordinary makes the event ordinary, and derived ones
count only without unknown ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUSION = "retrieval_derived"


@dataclass(frozen=True)
class Routes:
    """What an engine can be asked: the program it is called by, the leading words of
    its commands that read history and of the others, the name it serves tools by
    (default: the program's) and the tools that read. Whoever runs an engine
    knows its routes; none are assumed."""

    program: str
    reads: tuple[str, ...]
    others: tuple[str, ...] = ()
    server: str | None = None
    read_tools: tuple[str, ...] = ()


def _leads(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(f"{w} ")) for w in words], F.lit(False))


def command_class(command: Column, routes: Routes) -> Column:
    """Class of a command line; anything that a shell would compose is unknown."""
    line = F.concat(F.trim(F.regexp_replace(command, "[ \t]+", " ")), F.lit(" "))
    tail = F.regexp_replace(line, r"\A[^ ]+ ", "")
    direct = ~line.rlike(r"[;&|<>`\n]|\$\(") & (F.substring_index(line, " ", 1) == routes.program)
    return F.when(direct & _leads(tail, routes.reads), "derived").when(direct & _leads(tail, routes.others), "ordinary").otherwise("unknown")


def tool_class(server: Column, tool: Column, routes: Routes) -> Column:
    """Class of a call of a served tool."""
    ours = F.coalesce(server == (routes.server or routes.program), F.lit(False))
    return F.when(ours & tool.isin(*routes.read_tools), "derived").when(ours, "ordinary").otherwise("unknown")


def classified(events: DataFrame, routes: Routes) -> DataFrame:
    """``events`` with ``discovery_exclusion`` set on calls of the engine and on the results of such calls.

    Calls are tool calls and started commands: of a served tool, or with a command
    among their facts. Results name their call (``call_id``) within a session and say
    how it ended (``result_status``). What is excluded for another reason stays so.
    """
    is_call = F.col("event_type").isin("tool_call", "command_started")
    is_result = F.col("event_type").isin("tool_output", "command_output", "command_finished")
    command = F.get(F.filter("facts", lambda f: f["kind"] == "command"), F.lit(0))["value"]
    by_tool, by_command = tool_class(F.col("server"), F.col("tool"), routes), command_class(command, routes)
    of_call = F.when(by_tool != "unknown", by_tool).otherwise(by_command)
    keys = ["session_id", "call_id"]
    calls = events.filter(is_call).select("event_id", *keys, of_call.alias("class"))
    results = events.filter(is_result & F.col("call_id").isNotNull()).select("event_id", *keys, F.col("result_status").alias("status"))
    found = result_classes(results, calls.filter(F.col("call_id").isNotNull()), keys).unionByName(calls.select("event_id", "class"))
    derived = found.filter(F.col("class") == "derived").select("event_id").distinct().withColumn("__derived", F.lit(True))
    marked = events.join(derived, "event_id", "left")
    return marked.withColumn("discovery_exclusion", F.coalesce("discovery_exclusion", F.when(F.col("__derived"), EXCLUSION))).select(*events.columns)


def reduced(classes: Column) -> Column:
    """One class for all contributions of a group, an aggregate."""
    ordinary, derived, unknown = (F.coalesce(F.bool_or(classes == c), F.lit(False)) for c in ("ordinary", "derived", "unknown"))
    return F.when(ordinary, "ordinary").when(derived & ~unknown, "derived").otherwise("unknown")


def result_classes(results: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """(event_id, class) of results, from ``calls`` with ``keys`` and ``class``.

    ``status`` of a result is succeeded, failed or anything else (unknown).
    Calls that share their keys are reduced before the join, so no row is multiplied.
    """
    by_call = calls.groupBy(*keys).agg(reduced(F.col("class")).alias("__call"))
    linked = results.join(by_call, keys, "left")
    one = F.when(F.col("status") == "failed", "ordinary").when(F.col("status") == "succeeded", F.coalesce("__call", F.lit("unknown"))).otherwise("unknown")
    return linked.select("event_id", one.alias("__one")).groupBy("event_id").agg(reduced(F.col("__one")).alias("class"))


def exclusion(event_class: Column) -> Column:
    """What ``discovery_exclusion`` holds for an event of this class."""
    return F.when(event_class == "derived", EXCLUSION)
