"""Mixing sources to target weights.

Tokens are aggregated per source, a target is set for each source, the
repetition rate is target over size, and every document is taken floor(rate)
times plus one more time with a probability of the rate's fraction. The draw
is a hash of id, text and seed, so reruns agree and no state is kept.

Defined results: null text has size 0 and is taken 0 words; the null source is
a source of its own, last in order; repeated rows draw alike; a source whose
documents are all empty has target 0; an empty table gives an empty result;
further columns of the input pass through unless they carry one of the added
names, which then replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, kept_columns, packed, quoted, text_or_empty, unpacked

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_RATE = 2.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``total_share`` of all words. A source at its limit of ``max_rate`` times
    its size stops there, and the excess is shared anew by weight until no
    target is above its limit. Sharing anew ends at a common level L with
    target = min(limit, weight * L), so with sources ordered by limit / weight
    the stopped ones are a leading run, found with running sums. One row per
    source enters that window, not one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    weighed = (
        per_source.withColumn("weight", weight)
        .withColumn("limit", F.lit(max_rate) * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("rest", F.lit(total_share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stopped", F.col("ratio") * F.col("rest_weight") <= F.col("rest"))
    )
    level = F.min(F.when(~F.col("stopped"), F.struct("ratio", (F.col("rest") / F.col("rest_weight")).alias("level")))).over(everything)["level"]
    return weighed.withColumn("level", level).select("source", "source_size", F.when(F.col("stopped"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("level"))).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", keep: list[str] | None = None, emit: bool = False) -> DataFrame:
    """Add size, source_size, target, copies and taken to every document.

    ``emit``: return each document as often as the mix takes it instead (rows
    taken 0 times go). ``keep``: columns to pass through, all by default.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    columns = kept_columns(docs, keep, own)
    text = text_or_empty(text_column)
    draw = F.pmod(F.xxhash64(F.col(quoted(id_column)), text, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    sized = docs.select(
        packed(columns),
        F.col(quoted(source_column)).alias("source"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"),
        draw.alias("draw"),
    )
    targets = source_targets(sized.select("source", "size")).withColumnRenamed("source", "name")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MAX_RATE))).otherwise(F.lit(0.0))
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    # No broadcast hint: the engine broadcasts the targets only below its size threshold.
    mixed = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("rate", rate)
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    if emit:
        mixed = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return mixed.select(*unpacked(columns), *own)
