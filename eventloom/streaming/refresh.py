"""Incremental refresh with Structured Streaming.

``growing`` publishes what is new in watched files; here are the deliveries that
tell of changes: told apart by (epoch, sequence), where an older epoch or a
sequence not above the last one is a repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET_MS, LONGEST_MS = 250, 2000


def new_deliveries(stream: DataFrame) -> DataFrame:
    """Drop repeated deliveries of a stream with route, epoch and sequence."""
    return stream.dropDuplicates(["route", "epoch", "sequence"])


DUE_SCHEMA = "route string, epoch long, sequence long, due_ms long"
DUE_STATE = "epoch long, sequence long, first_ms long, last_ms long"


def _ledger(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Newest delivery of a route and when it is due: quiet for 250 ms, 2 s at most."""
    epoch, sequence, first, last = state.get if state.exists else (-1, -1, None, None)
    seen = False
    for pdf in batches:
        for r in pdf.sort_values(["epoch", "sequence"]).itertuples():
            if r.epoch < epoch or (r.epoch == epoch and r.sequence <= sequence):
                continue
            epoch, sequence, seen = int(r.epoch), int(r.sequence), True
            first, last = (int(r.at_ms) if first is None else first), int(r.at_ms)
    if seen:
        state.update((epoch, sequence, first, last))
        yield pd.DataFrame([(key[0], epoch, sequence, min(last + QUIET_MS, first + LONGEST_MS))], columns=["route", "epoch", "sequence", "due_ms"])


def dirty_ledger(stream: DataFrame) -> DataFrame:
    """(route, epoch, sequence, due_ms) of routes with new deliveries.

    ``stream``: route, epoch, sequence, at_ms.
    """
    return stream.groupBy("route").applyInPandasWithState(_ledger, DUE_SCHEMA, DUE_STATE, "update", "NoTimeout")


def retry_state(attempts: DataFrame, base_ms: int = 1000, most_ms: int = 300_000) -> DataFrame:
    """Back-off of each route from its attempts (route, at_ms, outcome).

    Doubles with each failure since the last success; a permanent failure blocks.
    """
    ok = F.max(F.when(F.col("outcome") == "success", F.col("at_ms")))
    last_ok = attempts.groupBy("route").agg(ok.alias("ok_ms"))
    since = attempts.join(last_ok, "route").filter(F.col("ok_ms").isNull() | (F.col("at_ms") > F.col("ok_ms")))
    wait = F.least(F.lit(most_ms), F.lit(base_ms) * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(30))))
    return (
        since.groupBy("route")
        .agg(F.count(F.lit(1)).alias("failures"), F.max("at_ms").alias("last_ms"), F.max((F.col("outcome") == "permanent").cast("int")).alias("p"))
        .select("route", "failures", (F.col("p") == 1).alias("blocked"), F.when(F.col("p") == 0, (F.col("last_ms") + wait).cast("long")).alias("not_before_ms"))
    )


def streamed_totals(stream: DataFrame, keys: list[str], measure: str, checkpoint: str, name: str) -> StreamingQuery:
    """Running count and sum by key of everything that has arrived."""
    totals = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
