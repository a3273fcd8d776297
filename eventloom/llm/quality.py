"""Quality rules by cross-document line frequency [DataFrame functions only].

Lines are normalised and hashed; for every host and line the distinct documents
that carry it are counted; lines above the limits are removed; documents that
are left depleted are rejected. Rules within one document (word counts,
symbols, repeated lines and windows) come first.

*Distinct documents.* Documents of a host with equal whole texts are one, so a
passage isn't boilerplate because its document was served again. Near copies
are documents of their own: lines that over ``min_documents`` of them share are
removed like any other line. Finding near copies is the join's business.

*Limits.* A line is removed where it is found in over ``min_documents``
distinct documents of its host and in over ``max_share`` of them. A document is
depleted if the lines removed hold over ``max_removed`` of its words or fewer
than ``min_words`` words are left.

Hosts, lines and texts are known by 64-bit hashes; equal hashes are taken for
equality.

Defined results: null text counts as empty and fails; the null host is a host;
repeated rows are judged alike and all kept in the result; a line without a
word is never counted; an empty table gives an empty result. Added columns
replace input columns of the same name in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_PATTERN, bitmap_split, kept_columns, packed, quoted, skew_join, staged, text_or_empty, unpacked

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCUMENTS = 20
MAX_SHARE = 0.005
MAX_REMOVED = 0.8
SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(words: Column, n: int = WINDOW_WORDS) -> Column:
    """How many words stand in an n-word window that is found twice or more.

    Windows are compared by 64-bit hashes. Most texts have no repeated window,
    which a set of hashes shows; only the others sort their windows.
    """

    def covered(grams: Column) -> Column:
        marked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def from_sorted(s: Column) -> Column:
            twin = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["g"] == x["g"])),
            )
            places = F.array_sort(F.transform(twin, lambda x: x["i"]))
            return _let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.lit(n), F.get(p, k + 1) - x)).otherwise(F.lit(n))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(marked, from_sorted))

    def grams_of(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - n)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < n + 1, F.lit(0).cast("long")).otherwise(_let(hashed, lambda h: _let(grams_of(h), covered)))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE_CLASS + "+", " "))


def frequent_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, rows) above both limits; ``lines``: host, line and document.

    Documents are told apart before they are counted, so no line's documents
    are ever gathered, and counts are summed in each task before they are moved.
    """
    once = lines.groupBy("host", "line", "document").agg(F.count(F.lit(1)).alias("rows"))
    counted = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("found"), F.sum("rows").alias("rows")).filter(F.col("found") > min_documents)
    hosts = lines.select("host", "document").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    return counted.join(hosts, "host").filter(F.col("found") > F.col("documents") * max_share).select("host", "line", "rows")


def quality_rules(
    docs: DataFrame,
    text_column: str = "text",
    host_column: str = "source",
    keep: list[str] | None = None,
    clean_text: bool = False,
    removed_lines: bool = False,
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    max_removed: float = MAX_REMOVED,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Judge every row; adds n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_removed_words and kept.

    ``keep``: columns to pass through, all by default. ``clean_text``: also
    return ``clean_text``, the text without the lines removed; ``removed_lines``:
    the hashes of these lines (null if none).
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept", "clean_text", "removed_lines"]
    columns = kept_columns(docs, keep, own)
    text = F.col("text")
    has_word = lambda line: F.rlike(line, F.lit(WORD_PATTERN))
    hashed = F.transform(F.col("split"), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.regexp_count(x, F.lit(WORD_PATTERN)).cast("int").alias("n")))
    host = F.col(quoted(host_column))
    texts = docs.select(packed(columns), F.xxhash64(host.isNull(), host.cast("string")).alias("host"), text_or_empty(text_column).alias("text"))
    measured = (
        texts.withColumn("words", word_array(text))
        .withColumn("split", F.filter(F.split(text, "\n", -1), has_word))
        .select(
            "kept",
            "host",
            *(["text"] if clean_text else []),
            F.xxhash64("text").alias("document"),
            F.size("words").cast("long").alias("n_words"),
            (F.length("text") - F.regexp_count("text", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("split") - F.size(F.array_distinct("split"))).cast("long").alias("n_dup_lines"),
            repeated_window_words(F.col("words")).alias("n_repeat_words"),
            hashed.alias("lines"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    measured = staged(measured, "quality")  # row numbers are settled here
    distinct = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    # A document without lines still counts for its host: it comes with a null line.
    carried = measured.select("host", "document", F.explode_outer(distinct).alias("line"))
    frequent = staged(frequent_lines(carried, min_documents, max_share).filter(F.col("line").isNotNull()), "frequent")
    lines = measured.select("row", "host", F.explode("lines").alias("l")).select("row", "host", F.col("l.h").alias("line"), F.col("l.n").alias("n"))
    key = F.xxhash64("host", "line").alias("key")
    may, _ = bitmap_split(lines.withColumn("key", key), "key", frequent.select(key))
    removed = (
        skew_join(may.drop("key"), frequent, ["host", "line"], "rows")
        .groupBy("row")
        .agg(F.sum("n").alias("n_removed_words"), *([F.collect_set("line").alias("removed_lines")] if clean_text or removed_lines else []))
    )
    removed = staged(removed, "removed").withColumnRenamed("row", "row2")
    # Rows that lose no line need no join.
    touched, whole = bitmap_split(measured.drop("lines", "document").withColumn("key", F.xxhash64("row")), "key", removed.select(F.xxhash64("row2").alias("key")))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in removed.schema.fields[1:]]
    out = touched.join(removed, F.col("row") == F.col("row2"), "left").drop("row2").unionByName(whole.select("*", *nothing))
    gone = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    verdict = {
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        "n_removed_words": gone,
        "clean_text": without_lines("text") if clean_text else None,
        "removed_lines": F.col("removed_lines") if removed_lines else None,
    }
    depleted = (gone > 0) & ((gone > F.col("n_words") * max_removed) | (F.col("n_words") - gone < min_words))
    verdict["kept"] = ~verdict["base_failed"] & ~depleted
    added = [verdict.get(c, F.col(c)) for c in own]
    return out.select(*unpacked(columns), *[c.alias(n) for c, n in zip(added, own, strict=True) if c is not None])


def without_lines(text: str) -> Column:
    """The text without the lines in ``removed_lines``; as it is where that is null."""
    left = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("removed_lines", F.xxhash64(normal_line(x))) | ~F.rlike(x, F.lit(WORD_PATTERN)))
    return F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))


def clean_documents(docs: DataFrame, text_column: str = "text", host_column: str = "source", **limits) -> DataFrame:
    """The documents that are kept, all columns, texts without the lines removed.

    A verdict depends on host and text alone, so it is joined by their hashes,
    and only to rows that are rejected or changed (and the few that share a bit
    with one); the others stay where they are.
    """
    host, text = F.col(quoted(host_column)), F.col(quoted(text_column))
    keys = [F.xxhash64(host.isNull(), host, text).alias("key"), F.xxhash64(F.lit(1), text, host, host.isNull()).alias("check")]
    rows = docs.select(packed(docs.columns), *keys)
    judged = quality_rules(docs.select(*keys, host.alias("host"), text.alias("text")), "text", "host", keep=["key", "check"], removed_lines=True, **limits)
    special = judged.filter(~F.col("kept") | F.col("removed_lines").isNotNull()).groupBy("key", "check").agg(F.first("kept").alias("stays"), F.first("removed_lines").alias("removed_lines"), F.count(F.lit(1)).alias("rows"))
    special = staged(special, "verdicts")
    may, rest = bitmap_split(rows, "key", special)
    may = skew_join(may, special, ["key", "check"], "rows", "left").filter(F.coalesce("stays", F.lit(True)))
    may = may.withColumn("text", F.col("kept").getField(text_column))
    changed = may.select(*[without_lines("text").alias(c) if c == text_column else x for c, x in zip(docs.columns, unpacked(docs.columns), strict=True)])
    return rest.select(*unpacked(docs.columns)).unionByName(changed)
