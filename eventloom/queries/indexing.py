"""An index that grows with publications, and searches that settle early."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adaptive, shaping
from ..operators.segments import SegmentedIndex
from ..schema import conform
from ..snapshots import Snapshots
from .ingest import shared_folder
from .retrieval import TALK_TERMS, TERMS, _TALK, _bm25_sql
from .tables import TOKENS_SQL, document_events, transcript_events

SOURCES = 7


def _published(spark: SparkSession, sf_dir: str) -> tuple[SegmentedIndex, list[tuple[int, int]]]:
    """Documents in five publications, indexed after each: (publication, postings written)."""
    docs = document_events(spark, sf_dir)
    number = F.col("event_id")
    events = docs.select(F.lpad(number.cast("string"), 12, "0").alias("event_id"), F.concat(F.lit("d"), number % SOURCES).alias("source_key"), (number % 3).alias("part"), "provider", "body", F.lit("message").alias("event_type"), F.lit("selected").alias("policy_status"), F.col("source_format").alias("session_id"))
    of = lambda part: conform(events.filter(F.col("part") == part))
    store = Snapshots(spark, shared_folder(spark, "indexed"))
    steps = [
        {"replace": of(0)},
        {"append": of(1)},
        {"replace": conform(events.filter("source_key = 'd2' AND provider = 'en'"))},
        {"delete": ["d4"]},
        {"append": of(2).filter("source_key NOT IN ('d2', 'd4')")},
    ]
    written = []
    for n, step in enumerate(steps, 1):
        store.publish(**step)
        index = SegmentedIndex.update(store)
        written.append((n, index.written))
    return index, written


_built: dict[tuple[str, str], tuple[SegmentedIndex, list]] = {}


def _index(spark: SparkSession, sf_dir: str) -> tuple[SegmentedIndex, list]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = _published(spark, sf_dir)
    return _built[key]


def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 over the segments of five publications, as over a fresh index of the last."""
    index, _ = _index(spark, sf_dir)
    return index.best(TERMS, 20).pool.select("event_id", F.round("score", 6).alias("score"))


def search_segments_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _index(spark, sf_dir)
    return index.best(TERMS, 50, tiers=True).pool.select("event_id", F.col("coverage").cast("long").alias("coverage"), F.round("score", 6).alias("score"))


def segments_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each publication writes the postings of its own events."""
    _, written = _index(spark, sf_dir)
    return spark.createDataFrame(written, "publication long, postings long")


def search_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of conversations from a pool that grows until it settles the first 20."""
    store = Snapshots(spark, shared_folder(spark, "adaptive"))
    turns = transcript_events(spark, sf_dir)
    events = turns.withColumns({"event_id": F.lpad(F.col("event_id").cast("string"), 15, "0"), "session_id": F.lpad(F.col("session_id").cast("string"), 12, "0"), "source_key": F.concat(F.lit("c"), F.col("session_id") % 10), "policy_status": F.lit("selected")})
    store.publish(replace=conform(events))
    found = adaptive.candidates(SegmentedIndex.update(store), TALK_TERMS, 20, store.read().select("event_id", "session_id", "root_session_id", "event_type", "agent_scope", "occurred_at_ms", "event_sequence"), "all", tiers=False)
    window = shaping.result_window(shaping.diversified(shaping.session_champions(found.pool)), 20)
    return window.select(F.col("shown").cast("long").alias("shown"), F.col("session_id").cast("long").alias("session_id"), F.col("event_id").cast("long").alias("event_id"), F.round("score", 6).alias("score"), "more_available")


QUERIES = {f.__name__: f for f in (search_segments, search_segments_tiers, segments_written, search_adaptive)}

_CODED = "CASE WHEN doc_len < 40 THEN doc_len ELSE 24 + (((doc_len - 24) >> (length(bin(doc_len - 24)) - 4)) << (length(bin(doc_len - 24)) - 4)) END"
_LAST = "documents_last AS (SELECT * FROM documents WHERE doc_id % 7 NOT IN (2, 4) OR (doc_id % 7 = 2 AND lang = 'en'))"
_LAST_TOKENS = TOKENS_SQL.replace("FROM documents)", "FROM documents_last)").replace("FROM documents d", "FROM documents_last d")


def _byte_bm25(terms: list[str]) -> str:
    return _bm25_sql(terms).replace("0.75 * doc_len / mean_len", f"0.75 * ({_CODED}) / mean_len")


_SEGMENT_SCORES = f"WITH {_LAST}, {_LAST_TOKENS}, {_byte_bm25(TERMS)}"
ORACLE_SQL = {
    "search_segments": f"{_SEGMENT_SCORES} SELECT lpad(event_id::VARCHAR, 12, '0') AS event_id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, scored.event_id LIMIT 20",
    "search_segments_tiers": f"{_SEGMENT_SCORES} SELECT lpad(event_id::VARCHAR, 12, '0') AS event_id, coverage::BIGINT AS coverage, round(score, 6) AS score FROM scored ORDER BY scored.coverage DESC, round(scored.score, 9) DESC, scored.event_id LIMIT 50",
    "segments_written": f"""WITH {TOKENS_SQL}, p AS (SELECT DISTINCT event_id, term FROM toks),
n AS (SELECT CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS publication FROM p WHERE event_id % 3 < 2 OR event_id % 7 NOT IN (2, 4)
UNION ALL SELECT 3 FROM p JOIN documents ON doc_id = event_id WHERE event_id % 7 = 2 AND lang = 'en')
SELECT publication::BIGINT AS publication, count(n.publication) AS postings FROM (VALUES (1), (2), (3), (4), (5)) AS v(publication) LEFT JOIN n USING (publication) GROUP BY 1""",
    "search_adaptive": f"""WITH {_TALK}, {_byte_bm25(TALK_TERMS)},
champs AS (SELECT *, event_id // 1000 AS session_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY round(score, 9) DESC, event_id % 1000 DESC, event_id) AS rn FROM scored),
shown AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, session_id) AS shown FROM champs WHERE rn = 1)
SELECT shown, session_id, event_id, round(score, 6) AS score, (SELECT max(shown) > 20 FROM shown) AS more_available FROM shown WHERE shown <= 20""",
}
