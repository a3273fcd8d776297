"""Documents to packed training sequences, one stage after the other.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import mixing, ngram_join, packing, quality, secrets
from eventloom.llm.common import fresh, read_table, release, scratch_mark, shared_dir


def _with_text(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``docs`` with another text; n_chars follows where the text has changed."""
    changed = ~F.col(text).eqNullSafe(F.col("text"))
    return docs.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col(text)).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the lines removed go from the others' texts."""
    before = fresh("before", docs.columns)
    kept = quality.clean_documents(docs.withColumn(before, F.length("text").cast("long")))
    shorter = F.length("text") != F.col(before)
    return kept.withColumn("n_chars", F.when(shorter, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.one_per_component(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    return _with_text(secrets.scan_secrets(docs, redact=True), "redacted_text", docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as the mix takes it."""
    return mixing.mix_sources(docs, emit=True).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Near-duplicate links, secret spans and packing can't be expressed in SQL;
#: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        mark = scratch_mark(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, mark)  # the stage's own tables; its result is written
        docs = spark.read.parquet(path)
    return docs
