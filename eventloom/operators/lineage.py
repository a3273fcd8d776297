"""Copies of events and trees of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RELATIONSHIPS

MAX_TREE, MAX_ROUNDS = 4096, 64
SEARCH_POLICY, SHOW_POLICY = (3, 64), (20, 4096)


def copy_sources(events: DataFrame) -> DataFrame:
    """Copied events with their ancestor, if its session is the one claimed.

    (event_id, ancestor_event_id, resolved).
    """
    claims = events.filter(F.col("copy_ancestor_event_id").isNotNull()).select("event_id", F.col("copy_ancestor_event_id").alias("ancestor_event_id"), F.col("copy_ancestor_session_id").alias("__session"))
    there = events.select(F.col("event_id").alias("__id"), F.col("session_id").alias("__sid"))
    joined = claims.join(there, (F.col("ancestor_event_id") == F.col("__id")) & (F.col("__session") == F.col("__sid")), "left_outer")
    return joined.select("event_id", "ancestor_event_id", F.col("__id").isNotNull().alias("resolved"))


def copies_of(events: DataFrame, event_id, limit: int = SHOW_POLICY[0]) -> DataFrame:
    """Events copied from ``event_id``, by id."""
    return events.filter(F.col("copy_ancestor_event_id") == event_id).select("event_id", "session_id", F.coalesce("session_relationship", F.lit("unspecified")).alias("relationship")).orderBy("event_id").limit(limit)


def relationship_counts(events: DataFrame, event_id) -> DataFrame:
    """Copies of ``event_id`` by relationship; empty buckets are left out."""
    known = F.when(F.col("session_relationship").isin(*RELATIONSHIPS), F.col("session_relationship")).otherwise("unspecified")
    return events.filter(F.col("copy_ancestor_event_id") == event_id).groupBy(known.alias("relationship")).agg(F.count(F.lit(1)).alias("n"))


def _session_edges(events: DataFrame) -> DataFrame:
    return events.select("session_id", "parent_session_id", "root_session_id").distinct()


def session_tree(spark: SparkSession, events: DataFrame, start: list[str], max_sessions: int = MAX_TREE, max_rounds: int = MAX_ROUNDS) -> list[str] | None:
    """Sessions tied to ``start`` by parent or root claims, up and down.

    Each round is a join of the claims with the sessions found last; the set is
    bounded by ``max_sessions`` by contract, and None says it overflowed.
    """
    edges = _session_edges(events)
    links = edges.select(F.col("session_id").alias("a"), F.explode(F.array_compact(F.array("parent_session_id", "root_session_id"))).alias("b")).filter("a <> b")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().persist()
    try:
        found, fresh = set(start), set(start)
        for _ in range(max_rounds):
            if not fresh:
                return sorted(found)
            around = links.filter(F.col("a").isin(sorted(fresh))).select("b").distinct().limit(max_sessions + len(found) + 1)
            fresh = {r["b"] for r in around.collect()} - found
            found |= fresh
            if len(found) > max_sessions:
                return None
        return None
    finally:
        links.unpersist()


def _chains(sessions: DataFrame, start: DataFrame, max_ancestors: int) -> DataFrame:
    """(session_id, at, parent, claimed, depth): every session and its ancestors, itself at depth 0.

    One recursive query for all of ``start``; a chain of more than
    ``max_ancestors`` goes one step further and no more.
    """
    spark = sessions.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # read when the query runs; its rows grow with the sessions
    return spark.sql(
        """
        WITH RECURSIVE chain AS (
            SELECT session_id, session_id AS at, parent_session_id AS parent, root_session_id AS claimed, 0 AS depth FROM {start}
            UNION ALL
            SELECT c.session_id, s.session_id, s.parent_session_id, s.root_session_id, c.depth + 1
            FROM chain c JOIN {sessions} s ON c.parent = s.session_id WHERE c.depth <= {most})
        SELECT * FROM chain
        """,
        sessions=sessions,
        start=start,
        most=max_ancestors,
    )


def proven_roots(events: DataFrame, session_ids: DataFrame | None = None, max_ancestors: int = MAX_ROUNDS) -> DataFrame:
    """(session_id, proven_root) of all sessions, or of those in ``session_ids``.

    The root is where a chain of parents ends. It is null where the chain has a
    gap, a cycle or more than ``max_ancestors`` ancestors, where a session has
    several records that disagree, and where a session on the chain claims a root
    that is none of its ancestors (the root itself may claim itself only).
    """
    facts = _session_edges(events)
    one = facts.groupBy("session_id").agg(F.count(F.lit(1)).alias("records"), F.first("parent_session_id").alias("parent_session_id"), F.first("root_session_id").alias("root_session_id"))
    sessions = one.filter("records = 1").drop("records")
    asked = one.select("session_id") if session_ids is None else one.select("session_id").join(session_ids.select("session_id").distinct(), "session_id", "left_semi")
    start = sessions if session_ids is None else sessions.join(asked, "session_id", "left_semi")
    chains = _chains(sessions, start, max_ancestors)
    # Of each chain: its nodes by depth, so that every claim is looked up among those above it.
    node = F.struct("depth", "at", "parent", "claimed")
    whole = chains.groupBy("session_id").agg(F.sort_array(F.collect_list(node)).alias("chain"))  # at most max_ancestors + 2
    last = F.get("chain", F.size("chain") - 1)
    proven = F.forall(
        "chain",
        lambda n: n["claimed"].isNull()
        | F.when(n["depth"] == F.size("chain") - 1, n["claimed"] == n["at"]).otherwise(F.exists("chain", lambda m: (m["depth"] > n["depth"]) & (m["at"] == n["claimed"]))),
    )
    good = last["parent"].isNull() & (F.size("chain") <= max_ancestors + 1) & proven
    found = whole.select("session_id", F.when(good, last["at"]).alias("proven_root"))
    return asked.join(found, "session_id", "left")


def proven_root(events: DataFrame, session_id, max_depth: int = MAX_ROUNDS):
    """The proven root of one session; None if there is none."""
    kind = events.schema["session_id"].dataType.simpleString()
    asked = events.sparkSession.createDataFrame([(session_id,)], f"session_id {kind}")
    row = proven_roots(events, asked, max_depth).first()
    return None if row is None else row["proven_root"]


def lineage_report(events: DataFrame, event_id, policy: tuple[int, int] = SHOW_POLICY) -> dict[str, DataFrame]:
    """Ancestor, bounded copies and counts of an event."""
    return {
        "ancestor": copy_sources(events).filter(F.col("event_id") == event_id),
        "copies": copies_of(events, event_id, policy[0]),
        "counts": relationship_counts(events, event_id),
    }
