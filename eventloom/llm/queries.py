"""The thin queries over the driver's tables; production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_extract, media, mixing, near_vectors, ngram_join, packing, quality, ranked, runs, secrets, sharding, token_counts
from .common import read_table, shared_dir


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_records(docs, f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, keep=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    media.write_archives(read_table(spark, sf_dir, "documents"), path)
    return media.media_features(media.read_archives(spark, path))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = quality.quality_rules(docs, keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.ranked_search(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return near_vectors.near_duplicate_vectors(vectors, 0.9, keep=["vec_id"])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs, keep=["doc_id"])
    return found.select("doc_id", *runs.digests(found), "n_words", "n_dropped", "n_searched")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_chat_format": op7_chat_format,
    "op8_media_columns": op8_media_columns,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_neardup": op12_embedding_neardup,
    "op13_periodic_runs": op13_periodic_runs,
}

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": f"""
        WITH cut AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
        postings AS (SELECT doc_id, term, count(*) AS tf FROM cut GROUP BY ALL),
        sizes AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id),
        corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
        weights AS (
            SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM postings, corpus GROUP BY term, big_n),
        asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        scored AS (
            SELECT item_id, doc_id,
                   sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (doc_id), corpus
            GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """,
    "op12_embedding_neardup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
        named AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
        degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM named LEFT JOIN degrees USING (vec_id)
    """,
}
