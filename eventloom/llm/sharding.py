"""Sharding over fixed virtual slots [DataFrame functions only].

Every record is hashed into one of a fixed number of virtual slots. Bytes are
summed per slot, and a slot-to-shard map is planned from those sums; records
never move on their own, only slots do. A map is a small table with a version:
``plan_slots`` makes the first, ``rebalance_slots`` and ``grow_slots`` edit one
into the next, ``save_slot_map`` and ``load_slot_map`` keep all versions.

Rows of a slot map: as many as there are virtual slots with records, at most
``n_slots``. That is the proven bound of everything here that is gathered in
one row or broadcast; it doesn't grow with the records.

Defined results: null text counts as empty; a null id is hashed with the text,
so rows without id spread like others; repeated rows are all kept, each with a
place of its own; an empty table gives an empty result; other columns pass
through untouched as long as their names differ from the ones added (``size``,
``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``,
``virtual_slot``), which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_columns, packed, quoted, text_or_empty, unpacked

N_SLOTS = 16384
ROW_OVERHEAD = 16


def virtual_slot(id_column: str, text_column: str, n_slots: int = N_SLOTS) -> Column:
    """The record's virtual slot; id and text decide, nothing else."""
    return F.pmod(F.xxhash64(F.col(quoted(id_column)), F.crc32(text_or_empty(text_column).cast("binary"))), F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of every virtual slot; ``records`` has virtual_slot and size."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _deal(slots: DataFrame, loads: Column, n_shards: int) -> DataFrame:
    """Deal ``slots`` in falling order of bytes, a round of ``n_shards`` at a time.

    In each round the largest slot goes to the least loaded shard, the second
    to the second least, and so on. ``loads``: array of (bytes, shard) at start.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "rows")))
    state = "struct<loads:array<struct<bytes:bigint,shard:int>>,dealt:array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>>"

    def one_round(acc: Column, start: Column) -> Column:
        batch = F.slice(F.col("slots"), start, F.lit(n_shards))
        ranked = F.array_sort(acc["loads"])
        used = F.zip_with(
            ranked,
            batch,
            lambda a, b: F.struct((a["bytes"] - F.coalesce(b["neg"], F.lit(0))).alias("bytes"), a["shard"].alias("shard")),
        )
        placed = F.zip_with(
            batch,
            F.slice(ranked, F.lit(1), F.size(batch)),
            lambda b, a: F.struct(b["virtual_slot"].alias("virtual_slot"), a["shard"].alias("shard"), (-b["neg"]).alias("bytes"), b["rows"].alias("rows")),
        )
        return F.struct(used.alias("loads"), F.concat(acc["dealt"], placed).alias("dealt")).cast(state)

    zero = F.struct(loads.alias("loads"), F.array().alias("dealt")).cast(state)
    starts = F.when(F.size("slots") > 0, F.sequence(F.lit(1), F.size("slots"), F.lit(n_shards))).otherwise(F.array().cast("array<int>"))
    return (
        slots.agg(order.alias("slots"))
        .select(F.aggregate(starts, zero, one_round)["dealt"].alias("dealt"))
        .select(F.explode("dealt").alias("d"))
        .select("d.*")
    )


def plan_slots(slots: DataFrame, n_shards: int) -> DataFrame:
    """First map: (virtual_slot, shard, bytes, rows), sizes near equal."""
    empty = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(F.lit(0).cast("long").alias("bytes"), s.cast("int").alias("shard")))
    return _deal(slots, empty, n_shards)


def rebalance_slots(slot_map: DataFrame, slots: DataFrame, n_shards: int, tolerance: float = 0.02) -> DataFrame:
    """Edit a map for new slot sizes and move as little as need be.

    A shard above (1 + tolerance) times the mean gives up its smallest slots
    until it is back at the mean; given-up and new slots are dealt to the least
    loaded shards. All other slots stay where the map has them.
    """
    now = slots.join(slot_map.select("virtual_slot", "shard"), "virtual_slot", "left")
    by_shard = Window.partitionBy("shard")
    total = now.agg((F.sum("bytes") / F.lit(n_shards)).alias("mean"))
    held = (
        now.filter(F.col("shard").isNotNull())
        .join(total)  # one row
        .withColumn("load", F.sum("bytes").over(by_shard))
        .withColumn("above", F.sum("bytes").over(by_shard.orderBy(F.col("bytes"), "virtual_slot")))
        .withColumn("leaves", (F.col("load") > F.col("mean") * (1 + tolerance)) & (F.col("above") <= F.col("load") - F.col("mean")))
    )
    stay = held.filter(~F.col("leaves")).select("virtual_slot", "shard", "bytes", "rows")
    moving = held.filter("leaves").select("virtual_slot", "bytes", "rows").unionByName(now.filter(F.col("shard").isNull()).select("virtual_slot", "bytes", "rows"))
    held_bytes = stay.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    shards = stay.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(held_bytes, "shard", "left")
    start = shards.agg(F.collect_list(F.struct(F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "shard")).alias("start"))  # n_shards entries
    return stay.unionByName(_deal_one_by_one(moving, start))


def _deal_one_by_one(slots: DataFrame, start: DataFrame) -> DataFrame:
    """Deal ``slots`` in falling order of bytes, each to the shard with the least load so far."""
    state = "struct<loads:array<struct<bytes:bigint,shard:int>>,dealt:array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>>"

    def one(acc: Column, slot: Column) -> Column:
        to = F.array_min(acc["loads"])
        loads = F.transform(acc["loads"], lambda x: F.when(x["shard"] == to["shard"], F.struct((x["bytes"] - slot["neg"]).alias("bytes"), x["shard"].alias("shard"))).otherwise(x))
        placed = F.struct(slot["virtual_slot"].alias("virtual_slot"), to["shard"].alias("shard"), (-slot["neg"]).alias("bytes"), slot["rows"].alias("rows"))
        return F.struct(loads.alias("loads"), F.concat(acc["dealt"], F.array(placed)).alias("dealt")).cast(state)

    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "rows")))
    both = slots.agg(order.alias("slots")).join(start)  # one row each
    zero = F.struct(F.col("start").alias("loads"), F.array().alias("dealt")).cast(state)
    return both.select(F.explode(F.aggregate("slots", zero, one)["dealt"]).alias("d")).select("d.*")


def grow_slots(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """Edit a map for one more shard: slots move only into the new shard.

    Every old shard gives slots, in hashed order, up to its share of bytes.
    """
    by_shard = Window.partitionBy("shard")
    run = F.sum("bytes").over(by_shard.orderBy(F.xxhash64("virtual_slot"), "virtual_slot"))
    gives = run <= F.sum("bytes").over(by_shard) / F.lit(n_shards + 1)
    return slot_map.withColumn("gives", gives).select("virtual_slot", F.when(F.col("gives"), F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "rows")


def save_slot_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a map as one more version beside the earlier ones; never overwrites."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_slot_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of a stored map, or the newest."""
    maps = spark.read.parquet(path)
    if version is not None:
        return maps.filter(F.col("version") == version).drop("version")
    newest = maps.agg(F.max("version").alias("newest"))
    return maps.join(newest, maps["version"] == newest["newest"], "left_semi").drop("version")


def shard_records(docs: DataFrame, map_path: str, n_shards: int = 40, id_column: str = "doc_id", text_column: str = "text", n_slots: int = N_SLOTS, keep: list[str] | None = None) -> DataFrame:
    """Put every row into a shard by way of its virtual slot.

    Stores the map under ``map_path`` as version 1. Adds size, text_crc32, law
    (``bytes``: sizes near equal), shard, slot (place in the shard, gapless
    from 0), grown_shard (null under this law) and virtual_slot. ``keep`` names
    the columns that pass through: by default the id alone, so that no text is
    shuffled.
    """
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot"]
    columns = kept_columns(docs, [id_column] if keep is None else keep, own)
    text = text_or_empty(text_column)
    digest = docs.select(
        packed(columns),
        F.col(quoted(id_column)).alias("id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(id_column, text_column, n_slots).alias("virtual_slot"),
    ).repartition("virtual_slot")  # serves the sums and the places alike
    save_slot_map(plan_slots(slot_bytes(digest), n_shards), map_path, 1)
    slot_map = load_slot_map(docs.sparkSession, map_path, 1)
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    plan = slot_map.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size")) - 1
    return (
        digest.withColumn("place", place)
        .join(F.broadcast(plan), "virtual_slot")  # at most n_slots rows
        .select(
            *unpacked(columns),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )
