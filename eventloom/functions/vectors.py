"""Vector expressions and the chunker for embedding documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_SLACK, SOURCE_CHARS = 1200, 200, 150, 65536


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, terms added from the first to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, dims: int | None = None) -> Column:
    """Unit vector; null where empty, of wrong length, not finite or zero."""
    bad = F.size(a) == 0
    if dims is not None:
        bad = bad | (F.size(a) != dims)
    bad = bad | F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (norm(a) == 0)
    return F.when(~bad, F.transform(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / n)), lambda v: v)[0])


def e5_passage(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("passage: ")), text).otherwise(F.concat(F.lit("passage: "), text))


def e5_query(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("query: ")), text).otherwise(F.concat(F.lit("query: "), text))


def header_value(value: Column, limit: int) -> Column:
    """White space collapsed, cut at ``limit`` characters with dots after it."""
    plain = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, limit), F.lit("..."))).otherwise(plain)


def document_header() -> Column:
    """Header lines of an embedded document, from the event columns."""

    def line(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (F.trim(value) != ""), F.concat(F.lit(f"{label}: "), value))

    facts = F.transform(F.coalesce("facts", F.array().cast("array<struct<kind:string,value:string>>")), lambda f: F.concat(F.lit("fact_"), f["kind"], F.lit(": "), header_value(f["value"], 240)))
    return F.concat_ws(
        "\n",
        F.lit("semantic_document: v3"),
        line("event_type", F.col("event_type")),
        line("role", F.col("role")),
        line("rank_bucket", header_value(F.col("rank_bucket"), 80)),
        line("provider", F.col("provider")),
        line("source_format", header_value(F.col("source_format"), 120)),
        line("agent_scope", F.col("agent_scope")),
        facts,
    )


def turn_text(user: Column, assistant: Column) -> Column:
    """One document of a user's turn and its answer, if there is one."""
    return F.concat_ws("\n\n", F.concat(F.lit("user:\n"), user), F.when(F.trim(assistant) != "", F.concat(F.lit("assistant:\n"), assistant)))


def chunk_spans(text: str) -> list[tuple[int, int]]:
    """Spans of at most ``CHUNK_CHARS`` with overlap; ends prefer white space."""
    spans, start, n = [], 0, len(text)
    while start < n:
        end = min(start + CHUNK_CHARS, n)
        if end < n:
            for i in range(end - 1, max(end - CHUNK_SLACK, start + 1) - 1, -1):
                if text[i].isspace():
                    end = i + 1
                    break
        spans.append((start, end))
        if end >= n:
            break
        start = max(0, end - CHUNK_OVERLAP)
    return spans


def chunks(docs: DataFrame, id_column: str, text_column: str, source_chars: int | None = SOURCE_CHARS) -> DataFrame:
    """(id, chunk_index, start_char, end_char, text, source_text_hash) of every chunk.

    The end of one chunk sets the start of the next, so a text is walked in Python.
    ``source_chars``: characters taken of each text; None for whole texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, i, a, b, text[a:b], digest) for key, text, digest in zip(pdf["id"], pdf["text"], pdf["digest"], strict=True) if isinstance(text, str) for i, (a, b) in enumerate(chunk_spans(text))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "start_char", "end_char", "text", "source_text_hash"])

    kind = docs.schema[id_column].dataType.simpleString()
    cut = F.col(text_column) if source_chars is None else F.substring(F.col(text_column), 1, source_chars)
    source = docs.select(F.col(id_column).alias("id"), cut.alias("text"), F.sha2(cut, 256).alias("digest"))
    return source.mapInPandas(run, f"id {kind}, chunk_index int, start_char int, end_char int, text string, source_text_hash string")


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text_column: str = "text", batch: int = 64) -> DataFrame:
    """``texts`` with the embedder's vectors in ``embedding``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = pdf[text_column].tolist()
            vectors = [v for i in range(0, len(values), batch) for v in embedder(values[i : i + batch])]
            yield pdf.assign(embedding=vectors)

    return texts.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in texts.schema)}, embedding array<float>")
