"""What a user calls: search, list, show, locate, status, import.

A ``History`` is pinned to one generation of a snapshot store, or to a
DataFrame of events. Every answer is a DataFrame; nothing is collected but ids
and terms of bounded number.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms, result_title, snippet
from ..functions.vectors import chunks, document_header, e5_passage, turn_text
from ..operators import adaptive, counts, lineage, lookup, projections, ranges, reconcile, search, sessions, shaping, vector
from ..operators.filters import EventFilters, outside_tree, semantic_candidate
from ..operators.retrieval_class import Routes, classified
from ..operators.segments import SegmentedIndex
from ..schema import conform
from ..snapshots import Snapshots
from ..sources import providers

DEFAULT_RESULTS, MAX_RESULTS = 20, 200
SHOWN = ("shown", "session_id", "event_id", "score", "more_matches", "more_available", "occurred_at_ms", "provider", "event_type", "role")


class History:
    def __init__(self, spark: SparkSession, events: DataFrame, generation: str = "none", vectors: DataFrame | None = None, index: SegmentedIndex | None = None):
        """``vectors``: event_id, chunk_index, source_text_hash and embedding, if there are any.

        ``index``: the events' term index; without one a search cuts all texts into tokens.
        """
        self.spark, self.generation, self.vectors, self.index = spark, generation, vectors, index
        self.events = conform(events)

    @staticmethod
    def open(store: Snapshots, generation: str | None = None, vectors: DataFrame | None = None, indexed: bool = False) -> History:
        """Pin the active or a named generation; ``indexed``: with its term index, brought up to date."""
        found = generation or store.active()
        if found is None:
            raise ValueError("nothing has been published")
        events = store.read(found)
        index = SegmentedIndex.update(store, found) if indexed else None
        return History(store.spark, events, found, vectors, index)

    # -- search ------------------------------------------------------------
    def backend(self, filters: EventFilters, wanted: str, weight: float) -> str:
        """lexical, semantic or hybrid, after what filters and vectors allow."""
        if wanted not in ("lexical", "semantic", "hybrid"):
            raise ValueError(f"unknown backend {wanted!r}")
        outside = filters.content_scope in ("calls", "outputs")
        if wanted == "semantic" and (outside or self.vectors is None):
            raise ValueError("semantic search has no vectors for this")
        return "lexical" if wanted == "hybrid" and (weight == 0 or outside or self.vectors is None) else wanted

    def search(
        self,
        texts: list[str],
        filters: EventFilters | None = None,
        limit: int = DEFAULT_RESULTS,
        backend: str = "lexical",
        query_vector: list[float] | None = None,
        weight: float = vector.SEMANTIC_WEIGHT,
        by_session: bool = True,
        active_session: str | None = None,
    ) -> DataFrame:
        """Shown results: sessions with their best event, or events."""
        if not 1 <= limit <= MAX_RESULTS:
            raise ValueError(f"limit must be in 1..{MAX_RESULTS}")
        chosen = replace(filters or EventFilters(), discoverable=True)
        kind = self.backend(chosen, backend, weight)
        rows = self.events.filter(chosen.column())
        if active_session is not None:
            rows = rows.filter(self.outside_active(active_session))
        terms = query_terms(self.spark, texts)
        if not terms and kind == "lexical":
            if chosen.file is None:
                return self._shown(shaping.result_window(shaping.diversified(shaping.session_champions(search.metadata_pool(rows.select(*projections.HIT_COLUMNS), 0))), limit), texts)
            pool = search.metadata_pool(rows.select(*projections.HIT_COLUMNS))
        elif kind == "lexical" and self.index is not None:
            pool = adaptive.candidates(self.index, terms, limit, rows.select(*projections.HIT_COLUMNS), chosen.content_scope, by_session).pool
        else:
            pool = self._pool(rows, terms, kind, chosen.content_scope, query_vector, weight)
        if by_session:
            shown = shaping.diversified(shaping.session_champions(pool))
        else:
            from pyspark.sql import Window

            shown = pool.withColumn("more_matches", F.lit(0)).withColumn("shown", F.row_number().over(Window.orderBy(*search.final_order())))  # a bounded pool
        return self._shown(shaping.result_window(shown, limit), texts)

    def _shown(self, window: DataFrame, texts: list[str]) -> DataFrame:
        """The window's rows with titles and snippets; bodies are read for them alone."""
        rows = window.select(*SHOWN).collect()  # MAX_RESULTS at most
        found = self.spark.createDataFrame(rows, window.select(*SHOWN).schema)
        mine = self.events.filter(F.col("session_id").isin(*{r["session_id"] for r in rows}) & F.col("event_id").isin(*[r["event_id"] for r in rows])).select("event_id", "body") if rows else self.events.limit(0).select("event_id", "body")
        cut = snippet(F.coalesce("body", F.lit("")), texts or [""])
        return found.join(mine, "event_id", "left").select("shown", "session_id", "event_id", "score", "more_matches", "more_available", "occurred_at_ms", "event_type", "role", result_title(F.col("provider"), F.col("role"), F.col("event_type")).alias("title"), cut["snippet"].alias("snippet"), cut["truncated"].alias("truncated")).orderBy("shown")

    def _pool(self, rows: DataFrame, terms: list[str], kind: str, scope: str, query_vector: list[float] | None, weight: float) -> DataFrame:
        slim = rows.select(*projections.HIT_COLUMNS)
        size = search.POOL if kind == "lexical" else vector.FUSION_POOL
        lexical = self._lexical(rows, terms, scope, size) if terms else None
        if kind == "lexical":
            return lexical.drop("coverage")
        near = vector.eligible(self.vectors, rows.filter(semantic_candidate()))
        best = vector.top_vectors(vector.best_chunks(vector.similarities(near, query_vector)), size)
        if kind == "semantic" or lexical is None:
            return slim.join(best.select("event_id", F.col("similarity").alias("score")), "event_id")
        placed = vector.ranked(lexical.withColumn("__tier", F.col("coverage") * 1e6 + F.col("score")), "__tier", "lexical_rank")
        fused = vector.fuse(placed, vector.ranked(best, "similarity", "semantic_rank"), weight)
        return slim.join(fused.select("event_id", "score"), "event_id")

    def _lexical(self, rows: DataFrame, terms: list[str], scope: str, size: int) -> DataFrame:
        """The ``size`` best of ``rows`` by coverage and score; statistics are those of all events."""
        if self.index is not None:
            return self.index.best(terms, size, rows.select(*projections.HIT_COLUMNS), scope, tiers=True).pool
        body = projections.body_search()
        corpus, mine = (search.with_tokens(x.withColumn("__search", body), "__search") for x in (self.events, rows))
        scored = search.lexical_scores(mine, corpus, terms, scope, byte_lengths=True)
        return search.coverage_pool(scored, size).select(*projections.HIT_COLUMNS, "coverage", "score")

    def outside_active(self, session_id: str):
        """Predicate that leaves out the session being worked in, with its tree."""
        root = lineage.proven_root(self.events, session_id)
        tree = lineage.session_tree(self.spark, self.events, [root or session_id])
        row = self.events.filter(F.col("session_id") == session_id).select("provider", "provider_session_id").limit(1).collect()
        return outside_tree(tree or [], row[0]["provider"] if row else None, row[0]["provider_session_id"] if row else None)

    # -- reads -------------------------------------------------------------
    def list_events(self, filters: EventFilters | None = None, limit: int = ranges.DEFAULT_LIMIT, cursor: str | None = None, descending: bool = False, content: str = "full") -> DataFrame:
        chosen = filters or EventFilters()
        key = None if cursor is None else ranges.decode_cursor(cursor, self.generation, chosen, descending)
        return projections.content(ranges.page(self.events.filter(chosen.column()), limit, key, descending), content)

    def next_cursor(self, page: DataFrame, filters: EventFilters | None = None, descending: bool = False) -> str | None:
        """Cursor behind the last row of a page; None behind an empty one."""
        last = page.orderBy(*ranges.range_order(not descending)).select(*ranges.KEYS).first()
        return None if last is None else ranges.encode_cursor(self.generation, filters or EventFilters(), tuple(last), descending)

    def _one_event(self, prefix: str) -> str:
        found = lookup.by_prefix(self.events, prefix).select("event_id").collect()
        if len(found) != 1:
            raise ValueError("no such event" if not found else "the prefix is ambiguous")
        return found[0]["event_id"]

    def show_event(self, prefix: str, before: int = 2, after: int = 2) -> dict[str, DataFrame]:
        event_id = self._one_event(prefix)
        return {"window": sessions.window_around(self.events, event_id, before, after), **lineage.lineage_report(self.events, event_id)}

    def show_session(self, session_id: str, mode: str = "lite", limit: int = 200) -> DataFrame:
        return sessions.session_page(self.events, session_id, mode, limit)

    def locate(self, prefix: str) -> DataFrame:
        return lookup.locate(self.events, prefix)

    def status(self) -> DataFrame:
        return counts.status_totals(self.events)


def import_records(store: Snapshots, records: DataFrame, source_format: str, expected: str | None = None, routes: Routes | None = None) -> str:
    """Parse records of a known format and publish their sources anew.

    With ``routes`` what repeats results of an engine's own searches is kept out of later ones.
    """
    events = providers.project_format(records, source_format)
    return store.publish(replace=events if routes is None else classified(events, routes), expected=expected)


def documents_to_embed(events: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Chunks of user turns with their answers whose text has no vectors yet.

    (event_id, chunk_index, start_char, end_char, text, source_text_hash).
    """
    asked = events.filter(semantic_candidate()).withColumn("rank_bucket", F.lit(None).cast("string"))
    paired = sessions.turns(events).select("event_id", "assistant_text")
    texts = asked.join(paired, "event_id", "left").select("event_id", document_header().alias("header"), turn_text(F.col("body"), F.col("assistant_text")).alias("text"))
    cut = chunks(texts, "event_id", "text").withColumnRenamed("id", "event_id")
    whole = cut.join(texts.select("event_id", "header"), "event_id").withColumn("text", e5_passage(F.concat_ws("\n\n", "header", "text"))).drop("header")
    return whole if vectors is None else reconcile.to_embed(whole, vectors)
