"""Search, shaping, vectors and fusion over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms, result_title, snippet, tokens
from ..operators import search, shaping, vector
from ..operators.term_index import TermIndex
from .ingest import shared_folder
from .tables import TABLE_EVENTS_SQL, TOKENS_SQL, document_events, table, table_events, transcript_events

QUERY = ["onble antion", "reen"]
TERMS = ["antion", "onble", "reen"]  # query_terms(QUERY)
TALK_QUERY = ["enten pour"]
TALK_TERMS = ["enten", "pour"]
FAMILY_TERMS = ["der", "the"]
VECTOR_ID = 7


def _bm25_sql(terms: list[str], extra: str = "") -> str:
    """Scores in a fixed order of terms; ``toks`` and ``lens`` must be defined."""
    tf = ", ".join(f"count(*) FILTER (WHERE term = '{t}') AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"(SELECT count(DISTINCT event_id) FROM toks WHERE term = '{t}') AS df{i}" for i, t in enumerate(terms))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * doc_len / mean_len)) ELSE 0.0 END" for i in range(len(terms)))
    cover = " + ".join(f"CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END" for i in range(len(terms)))
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""stats AS (SELECT count(*)::DOUBLE AS n, avg(doc_len) AS mean_len, {df} FROM lens),
tfs AS (SELECT event_id, {tf} FROM toks WHERE term IN ({listed}) GROUP BY event_id),
scored AS (SELECT t.event_id, {cover} AS coverage, {part} AS score{extra} FROM tfs t JOIN lens USING (event_id) CROSS JOIN stats)"""


_indexes: dict[tuple[str, str], TermIndex] = {}


def document_index(spark: SparkSession, sf_dir: str) -> TermIndex:
    """The documents' term index, written once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = TermIndex.write(document_events(spark, sf_dir), shared_folder(spark, "term-index"))
    return _indexes[key]


def _scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).scores(query_terms(spark, QUERY))


def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.best_scores(_scored_documents(spark, sf_dir), 20)
    return best.select("event_id", F.round("score", 6).alias("score"))


def search_coverage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.coverage_pool(_scored_documents(spark, sf_dir), 50)
    return pool.select("event_id", F.col("coverage").cast("long").alias("coverage"), F.round("score", 6).alias("score"))


def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter narrows what is found; statistics stay those of the corpus."""
    mine = document_events(spark, sf_dir).filter(F.col("provider") == "en").select("event_id", "source_format")
    best = search.best_scores(document_index(spark, sf_dir).scores(TERMS, mine), 20)
    return mine.join(F.broadcast(best), "event_id").select("event_id", "source_format", F.round("score", 6).alias("score"))  # 20 rows


def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 with title and snippet; bodies are read for the winners alone."""
    docs = document_events(spark, sf_dir)
    best = search.best_scores(document_index(spark, sf_dir).scores(TERMS), 20).select("event_id", "score")
    hit = docs.join(F.broadcast(best), "event_id")  # 20 rows
    cut = snippet(F.col("body"), ["reen"])
    return hit.select("event_id", result_title(F.col("provider"), F.lit(None).cast("string"), F.lit("message")).alias("title"), cut["snippet"].alias("snippet"), cut["truncated"].alias("truncated"))


def tokens_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).lengths.select("event_id", "doc_len")


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).document_frequencies()


def transcript_search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over conversations, one champion a session, 20 sessions."""
    corpus = search.with_tokens(transcript_events(spark, sf_dir))
    pool = search.coverage_pool(search.lexical_scores(corpus, corpus, TALK_TERMS, "all"), search.POOL)
    shown = shaping.diversified(shaping.session_champions(pool))
    window = shaping.result_window(shown, 20)
    return window.select(F.col("shown").cast("long").alias("shown"), "session_id", "event_id", F.round("score", 6).alias("score"), F.col("more_matches").cast("long").alias("more_matches"), "more_available")


_TALK = TOKENS_SQL.replace("doc_id AS event_id", "conv_id * 1000 + turn AS event_id").replace("FROM documents)", "FROM conversations)").replace("d.doc_id AS event_id", "d.conv_id * 1000 + d.turn AS event_id").replace("FROM documents d", "FROM conversations d").replace("= d.doc_id GROUP BY d.doc_id", "= d.conv_id * 1000 + d.turn GROUP BY ALL")


def fixture_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = search.with_tokens(table_events(spark, sf_dir))
    scored = search.lexical_scores(events, events, FAMILY_TERMS, "all")
    return scored.select("event_id", F.col("coverage").cast("long").alias("coverage"), F.round("score", 6).alias("score"))


def fixture_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = search.with_tokens(table_events(spark, sf_dir))
    scored = search.lexical_scores(events, events, FAMILY_TERMS, "all")
    shown = shaping.diversified(shaping.session_champions(scored))
    return shown.select(F.col("shown").cast("long").alias("shown"), "session_id", "event_id", F.col("round").cast("long").alias("round"))


_FIXTURE_SCORES = f"""WITH {TABLE_EVENTS_SQL},
toks AS (SELECT event_id, lower(unnest(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}]+'))) AS term FROM ev),
lens AS (SELECT e.event_id, count(t.term) AS doc_len FROM ev e LEFT JOIN toks t ON t.event_id = e.event_id GROUP BY ALL),
{_bm25_sql(FAMILY_TERMS)},
weighed AS (SELECT e.*, s.coverage, s.score * CASE WHEN event_type = 'message' THEN 1.0 WHEN event_type = 'summary' THEN 0.9 WHEN event_type IN ('tool_output', 'command_output', 'command_finished') THEN 0.6 ELSE 0.8 END AS score FROM scored s JOIN ev e USING (event_id))"""

_SESSION_ORDER = "round(score, 9) DESC, occurred_at_ms DESC NULLS LAST, event_sequence DESC, event_id"


def root_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = search.with_tokens(table_events(spark, sf_dir))
    strong = shaping.root_strength(search.lexical_scores(events, events, FAMILY_TERMS, "all"))
    return strong.select("root_id", F.round("strongest", 6).alias("strongest"), F.round("strongest_primary", 6).alias("strongest_primary"))


def metadata_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search without text: the pool is chosen by id, then put in shown order."""
    pool = search.metadata_pool(table_events(spark, sf_dir).filter(F.exists("facts", lambda f: f["kind"] == "file")), 3)
    return pool.orderBy(*search.final_order()).select("event_id", "occurred_at_ms")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == VECTOR_ID).first()["embedding"]


def _vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: four in a row belong to one event."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 4).alias("event_id"), (F.col("vec_id") % 4).cast("int").alias("chunk_index"), "vec_id", "embedding", "label")


def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vector.similarities(_vector_chunks(spark, sf_dir), _query_vector(spark, sf_dir))
    return vector.top_vectors(scored, 20, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


def vector_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vector.best_chunks(vector.similarities(_vector_chunks(spark, sf_dir), _query_vector(spark, sf_dir)))
    return vector.top_vectors(best, 20).select("event_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("similarity", 6).alias("similarity"))


def vector_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search among the documents labelled as good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    scored = vector.similarities(vector.eligible(_vector_chunks(spark, sf_dir), good, "vec_id"), _query_vector(spark, sf_dir))
    return vector.top_vectors(scored, 20, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical over documents and vectors of the same ids, fused by rank."""
    pool = search.coverage_pool(document_index(spark, sf_dir).scores(TERMS), vector.FUSION_POOL)
    # A text's place in the pool is its coverage tier first.
    lexical = vector.ranked(pool.withColumn("tiered", F.col("coverage") * 1000 + F.col("score")), "tiered", "lexical_rank")
    near = vector.similarities(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "event_id"), _query_vector(spark, sf_dir))
    semantic = vector.ranked(vector.top_vectors(near, vector.FUSION_POOL), "similarity", "semantic_rank")
    fused = vector.fuse(lexical, semantic)
    best = fused.orderBy(F.round("score", 12).desc(), "event_id").limit(20)
    return best.select("event_id", F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("semantic_rank").cast("long").alias("semantic_rank"), F.round("score", 9).alias("score"))


def alternatives_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score of each event over two alternative queries."""
    v = _vector_chunks(spark, sf_dir)
    rows = [vector.similarities(v, table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == q).first()["embedding"]) for q in (VECTOR_ID, 11)]
    best = vector.best_over_alternatives(rows[0].unionByName(rows[1]), "event_id", "similarity")
    return best.select("event_id", F.round("similarity", 6).alias("similarity"))


def tokenize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the benchmark items, with its place."""
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).select("item_id", F.col("pos").cast("long").alias("pos"), "term")


QUERIES = {
    f.__name__: f
    for f in (
        search_lexical, search_coverage_tiers, search_filtered, search_snippets, tokens_per_document, document_frequencies, transcript_search_sessions,
        fixture_class_weights, fixture_diversified, root_strength, metadata_list, vector_top_k, vector_best_chunk, vector_eligible, hybrid_search, alternatives_max, tokenize_all,
    )
}

_SIM = "sims AS (SELECT v.*, list_reduce(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE), lambda a, b: a + b) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {id}) q)"
_SIM7 = _SIM.format(id=VECTOR_ID)

ORACLE_SQL = {
    "search_lexical": f"WITH {TOKENS_SQL}, {_bm25_sql(TERMS)} SELECT event_id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, event_id LIMIT 20",
    "search_coverage_tiers": f"WITH {TOKENS_SQL}, {_bm25_sql(TERMS)} SELECT event_id, coverage::BIGINT AS coverage, round(score, 6) AS score FROM scored ORDER BY scored.coverage DESC, round(scored.score, 9) DESC, event_id LIMIT 50",
    "search_filtered": f"WITH {TOKENS_SQL}, {_bm25_sql(TERMS)} SELECT event_id, source AS source_format, round(score, 6) AS score FROM scored JOIN documents ON doc_id = event_id WHERE lang = 'en' ORDER BY round(scored.score, 9) DESC, event_id LIMIT 20",
    "search_snippets": f"""WITH {TOKENS_SQL}, {_bm25_sql(TERMS)}, best AS (SELECT event_id FROM scored ORDER BY round(score, 9) DESC, event_id LIMIT 20),
hit AS (SELECT event_id, lang, text, length(text) AS n, instr(lower(text), 'reen') AS pos FROM best JOIN documents ON doc_id = event_id),
cut AS (SELECT *, CASE WHEN n <= 320 OR pos = 0 THEN 0 ELSE least(greatest(pos - 1 - 158, 0), n - 320) END AS s FROM hit)
SELECT event_id, lang || ' message' AS title, substr(text, (s + 1)::BIGINT, 320) AS snippet, n > 320 AS truncated FROM cut""",
    "tokens_per_document": f"WITH {TOKENS_SQL} SELECT event_id, doc_len::BIGINT AS doc_len FROM lens",
    "document_frequencies": f"WITH {TOKENS_SQL} SELECT term, count(DISTINCT event_id) AS doc_freq, count(*) AS term_count FROM toks GROUP BY term",
    "transcript_search_sessions": f"""WITH {_TALK}, {_bm25_sql(TALK_TERMS)},
pool AS (SELECT *, event_id // 1000 AS session_id, event_id % 1000 AS event_sequence FROM scored ORDER BY coverage DESC, round(score, 9) DESC, event_id LIMIT 4096),
champs AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, event_sequence DESC, event_id) AS rn, count(*) OVER (PARTITION BY session_id) - 1 AS more_matches FROM pool),
shown AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, session_id) AS shown FROM champs WHERE rn = 1)
SELECT shown, session_id, event_id, round(score, 6) AS score, more_matches, (SELECT max(shown) > 20 FROM shown) AS more_available FROM shown WHERE shown <= 20""",
    "fixture_class_weights": f"{_FIXTURE_SCORES} SELECT event_id, coverage::BIGINT AS coverage, round(score, 6) AS score FROM weighed",
    "fixture_diversified": f"""{_FIXTURE_SCORES},
champs AS (SELECT * FROM (SELECT *, coalesce(root_session_id, session_id) AS root_id, row_number() OVER (PARTITION BY session_id ORDER BY {_SESSION_ORDER}) AS rn FROM weighed) WHERE rn = 1),
placed AS (SELECT *, max(score) OVER (PARTITION BY root_id) AS strongest, row_number() OVER (PARTITION BY root_id ORDER BY {_SESSION_ORDER}, session_id) AS place FROM champs),
picked AS (SELECT *, coalesce(min(CASE WHEN agent_scope = 'primary' AND score >= strongest * 0.95 THEN place END) OVER (PARTITION BY root_id), 1) AS champion FROM placed),
rounds AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY CASE WHEN place = champion THEN 0 ELSE place END) AS round FROM picked)
SELECT row_number() OVER (ORDER BY round, round(strongest, 9) DESC, root_id) AS shown, session_id, event_id, round FROM rounds""",
    "root_strength": f"{_FIXTURE_SCORES} SELECT coalesce(root_session_id, session_id) AS root_id, round(max(score), 6) AS strongest, round(max(CASE WHEN agent_scope = 'primary' THEN score END), 6) AS strongest_primary FROM weighed GROUP BY 1",
    "metadata_list": f"WITH {TABLE_EVENTS_SQL} SELECT event_id, occurred_at_ms::BIGINT AS occurred_at_ms FROM (SELECT * FROM ev WHERE len(list_filter(facts, lambda f: f.kind = 'file')) > 0 ORDER BY event_id LIMIT 3)",
    "vector_top_k": f"WITH {_SIM7} SELECT vec_id, round(similarity, 6) AS similarity FROM sims WHERE similarity > 0 ORDER BY round(sims.similarity, 12) DESC, vec_id LIMIT 20",
    "vector_best_chunk": f"""WITH {_SIM7}, best AS (SELECT vec_id // 4 AS event_id, vec_id % 4 AS chunk_index, similarity, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY similarity DESC, vec_id % 4) AS rn FROM sims WHERE similarity > 0)
SELECT event_id, chunk_index, round(similarity, 6) AS similarity FROM best WHERE rn = 1 ORDER BY round(best.similarity, 12) DESC, event_id LIMIT 20""",
    "vector_eligible": f"WITH {_SIM7} SELECT vec_id, round(similarity, 6) AS similarity FROM sims WHERE similarity > 0 AND vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY round(sims.similarity, 12) DESC, vec_id LIMIT 20",
    "hybrid_search": f"""WITH {TOKENS_SQL}, {_bm25_sql(TERMS)}, {_SIM7},
lex AS (SELECT event_id, row_number() OVER (ORDER BY round(coverage * 1000 + score, 9) DESC, event_id) AS lexical_rank FROM (SELECT * FROM scored ORDER BY coverage DESC, round(score, 9) DESC, event_id LIMIT 1600)),
sem AS (SELECT event_id, row_number() OVER (ORDER BY round(similarity, 9) DESC, event_id) AS semantic_rank FROM (SELECT vec_id AS event_id, similarity FROM sims WHERE similarity > 0 ORDER BY round(similarity, 12) DESC, vec_id LIMIT 1600)),
fused AS (SELECT coalesce(lex.event_id, sem.event_id) AS event_id, lexical_rank, semantic_rank, coalesce(0.65::DOUBLE / (60 + lexical_rank), 0) + coalesce(0.35::DOUBLE / (60 + semantic_rank), 0) AS score FROM lex FULL OUTER JOIN sem ON lex.event_id = sem.event_id)
SELECT event_id, lexical_rank, semantic_rank, round(score, 9) AS score FROM fused ORDER BY round(fused.score, 12) DESC, event_id LIMIT 20""",
    "alternatives_max": f"WITH a AS (WITH {_SIM7} SELECT vec_id // 4 AS event_id, similarity FROM sims WHERE similarity > 0), b AS (WITH {_SIM.format(id=11)} SELECT vec_id // 4 AS event_id, similarity FROM sims WHERE similarity > 0) SELECT event_id, round(max(similarity), 6) AS similarity FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY event_id",
    "tokenize_all": """WITH runs AS (SELECT item_id, unnest(l) AS run, generate_subscripts(l, 1) AS k FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS l FROM benchmark)),
toks AS (SELECT item_id, k, i, lower(substr(run, (i * 24 + 1)::BIGINT, 32)) AS term FROM runs, unnest(generate_series(0, CASE WHEN length(run) > 32 THEN ceil((length(run) - 32) / 24.0)::BIGINT ELSE 0 END)) AS g(i))
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY k, i) - 1 AS pos, term FROM toks""",
}
