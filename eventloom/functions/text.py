"""Tokens, lexical scores and snippets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts written without spaces, one token per character.
DENSE = (
    r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1100}-\x{11FF}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3130}-\x{318F}"
    r"\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
)
RUN_LIMIT, RUN_STRIDE = 32, 24
K1, B = 1.2, 0.75
SNIPPET_CHARS = 320
MAX_QUERY_TERMS = 32
MAX_ALTERNATIVES = 32
MAX_QUERY_BYTES = 64 << 10


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text: dense characters one by one, other runs of
    letters and digits whole, or in overlapping chunks where they are long.

    Plain letters have an alternative of their own: the class of all others is
    several times as slow, and possessive groups take runs of any length.
    """
    other = rf"[[\p{{IsAlphabetic}}\p{{N}}]&&[^{DENSE}]]"
    runs = F.regexp_extract_all(text, F.lit(rf"(?:[A-Za-z0-9]++|{other})++|[{DENSE}]"), F.lit(0))

    def chunks(run: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(run) - RUN_LIMIT) / RUN_STRIDE)).cast("int")
        return F.when(F.length(run) <= RUN_LIMIT, F.array(run)).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(run, i * RUN_STRIDE + 1, F.lit(RUN_LIMIT)))
        )

    def cut(found: Column) -> Column:
        return F.when(F.exists(found, lambda run: F.length(run) > RUN_LIMIT), F.flatten(F.transform(found, chunks))).otherwise(found)

    return F.transform(F.transform(F.array(runs), cut)[0], F.lower)


def term_counts(token_column: Column) -> Column:
    """(term, tf) of the distinct tokens, in order of the terms: counted inside of the row."""

    def counted(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        one = lambda at: F.transform(at, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("long").alias("tf")))
        return F.transform(F.array(starts), one)[0]

    some = F.when(F.size(token_column) > 0, token_column)  # a sequence from 0 to -1 isn't empty
    return F.coalesce(F.transform(F.array(F.sort_array(some)), lambda t: F.when(t.isNotNull(), counted(t)))[0], F.array().cast("array<struct<term:string,tf:bigint>>"))


def query_terms(spark, texts: list[str]) -> list[str]:
    """Distinct sorted tokens of query alternatives, at most ``MAX_QUERY_TERMS``."""
    live = [t.strip() for t in texts if t and t.strip()]
    if len(live) > MAX_ALTERNATIVES or sum(len(t.encode()) for t in live) > MAX_QUERY_BYTES:
        raise ValueError("query too large")
    if not live:
        return []
    row = spark.range(1).select(F.array_distinct(F.flatten(F.array(*[tokens(F.lit(t)) for t in live]))).alias("t")).first()
    found = sorted(row["t"])
    if len(found) > MAX_QUERY_TERMS:
        raise ValueError(f"more than {MAX_QUERY_TERMS} distinct terms")
    return found


def term_frequencies(token_column: Column, terms: list[str]) -> Column:
    """How often each term occurs, in the order of ``terms``."""
    wanted = F.array(*[F.lit(t) for t in terms])
    hits = F.filter(token_column, lambda t: F.array_contains(wanted, t))
    return F.transform(F.array(hits), lambda h: F.transform(wanted, lambda t: F.size(F.filter(h, lambda x: x == t))))[0]


def idf(n_documents: Column, n_with_term: Column) -> Column:
    return F.log(F.lit(1.0) + (n_documents - n_with_term + 0.5) / (n_with_term + 0.5))


def bm25_term(tf: Column, idf_value: Column, length: Column, mean_length: Column) -> Column:
    return idf_value * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * length / mean_length))


def length_code(length: Column) -> Column:
    """A length in one byte: itself below 24, then what is over 24 as a binary
    exponent and three digits after the first, so exact up to 40."""
    over = (length - 24).cast("long")
    digits = F.length(F.bin(over))
    shift = F.greatest(digits - 4, F.lit(0))
    coarse = F.when(over < 8, over).otherwise(F.call_function("shiftright", over, shift).bitwiseAND(F.lit(7).cast("long")) + (shift + 1) * 8)
    return F.when(length < 24, length).otherwise(F.lit(24) + coarse).cast("int")


def length_of_code(code: Column) -> Column:
    """The length that a code stands for, the least of those with that code."""
    coarse = (code - 24).cast("long")
    shift = F.floor(coarse / 8).cast("int") - 1
    long = F.when(coarse < 8, coarse).otherwise(F.call_function("shiftleft", (coarse % 8).bitwiseOR(F.lit(8).cast("long")), shift))
    return F.when(code < 24, code).otherwise(F.lit(24) + long).cast("long")


def class_weight(event_type: Column, scope: str = "all") -> Column:
    """Weight of an event's class; it scales the score and never filters."""
    if scope == "all":
        return (
            F.when(event_type == "message", 1.0)
            .when(event_type == "summary", 0.9)
            .when(event_type.isin("tool_output", "command_output", "command_finished"), 0.6)
            .otherwise(0.8)
        )
    if scope == "transcript":
        return F.when(event_type == "message", 1.0).otherwise(0.9)
    return F.lit(1.0)


def folded_contains(value: Column, needle: str) -> Column:
    """Substring test in Unicode lower case."""
    return F.contains(F.lower(value), F.lit(needle.lower()))


def result_title(provider: Column, role: Column, event_type: Column) -> Column:
    return F.concat_ws(" ", provider, role, event_type)


def _first_match(body: Column, needles: list[str]) -> Column:
    """(place from 1, length) of the longest needle found; ties go to the earliest."""
    low = F.lower(body)
    found = F.filter(
        F.array(*[F.struct(F.lit(len(n)).alias("size"), (-F.instr(low, F.lit(n.lower()))).alias("neg")) for n in needles]),
        lambda m: m["neg"] < 0,
    )
    return F.array_max(found)


def snippet(body: Column, query_texts: list[str], limit: int = SNIPPET_CHARS) -> Column:
    """(snippet, truncated): at most ``limit`` characters around the best match.

    The longest whole query found wins, else the longest single term; characters
    are code points here.
    """
    import re

    whole = [t.strip() for t in query_texts if t.strip()]
    single = [w for t in whole for w in re.findall(r"[^\W_]+", t)]
    nothing = F.lit(None).cast("struct<size:int,neg:int>")
    match = F.coalesce(_first_match(body, whole) if whole else nothing, _first_match(body, single) if single else nothing)
    n = F.length(body)
    lead = F.floor(F.greatest(F.lit(0), F.lit(limit) - F.greatest(match["size"], F.lit(1))) / 2)
    start = F.when(n <= limit, F.lit(0)).otherwise(F.coalesce(F.least(F.greatest(-match["neg"] - 1 - lead, F.lit(0)), n - limit), F.lit(0))).cast("int")
    return F.struct(F.substring(body, start + 1, F.lit(limit)).alias("snippet"), (n > limit).alias("truncated"))


def shell_quoted(value: Column) -> Column:
    """A word for a suggested command: plain words as they are, others in single quotes."""
    return F.when(value.rlike(r"\A[A-Za-z0-9_./:@-]+\z"), value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\\''")), F.lit("'")))
