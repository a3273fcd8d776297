"""What is new in files that grow, told from certified frontiers.

A file's frontier is the end of its last complete line; its certificate is a
hash of all bytes before it, put together from hashes of fixed ranges. Both come
from one pass in which every range of every file is a row, so a large file is the
work of many tasks and nothing of a file is held but one block. A file whose bytes
before the known frontier hash as before was appended to; any other known file was
rewritten and is read anew.

Compressed files (``.zst``) have no lines to tell apart: they are unchanged, or
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import MAX_RECORD_BYTES, OPEN_BYTES, TASK_BYTES, BoundedJsonl, BoundedJsonlReader, LineRange, LineRanges, open_fs

HASH_RANGE = 8 << 20
LINE_RANGE = 32 << 20
BLOCK = 1 << 20
FILES = "file string, size long, modified long"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def list_files(path: str, suffixes: str, depth: int = 8) -> list[tuple[str, int, int]]:
    """(file, size, time of change) of the plain files of a bounded tree, in order."""
    found = BoundedJsonlReader({"path": path, "suffixes": suffixes, "depth": depth})._files() if open_fs(path)[0].get_file_info(open_fs(path)[1]).type else []
    return [(f.path, f.size, f.mtime_ns or 0) for f in found]


def listed(spark: SparkSession, path: str, suffixes: str = ".jsonl,.jsonl.zst,.json", depth: int = 8) -> DataFrame:
    return spark.createDataFrame(list_files(path, suffixes, depth), FILES)


_FACTS = "file string, start long, whole string, line_end long, line string, known string"


def _dealt(ranges: DataFrame, size: Column) -> DataFrame:
    """Ranges (file, start) dealt to as many tasks as the bytes behind them ask for.

    The number is stated, as ranges are few bytes themselves: adaptive execution
    would take thousands of files for one small partition.
    """
    total = ranges.agg(F.sum(size + OPEN_BYTES).alias("bytes")).first()["bytes"] or 0
    return ranges.repartition(max(1, -(-total // TASK_BYTES)), "file", "start")


def _hashed(scheme_path: str, hash_range: int):
    """Of each range: the hash of its bytes, of those to its last line's end, and of those to the known frontier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(scheme_path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                start, stop, known = r["start"], min(r["start"] + hash_range, r["size"]), r["frontier"]
                packed = r["file"].endswith(".zst")
                whole, line, line_end, at_known, at = hashlib.sha256(), None, None, None, start
                with fs.open_input_file(r["file"]) as raw:
                    raw.seek(start)
                    while at < stop and (block := raw.read(min(BLOCK, stop - at))):
                        if known is not None and at < known <= at + len(block):
                            here = whole.copy()
                            here.update(block[: known - at])
                            at_known = here.hexdigest()
                        cut = len(block) if packed else block.rfind(b"\n") + 1
                        if cut:
                            here = whole.copy()
                            here.update(block[:cut])
                            line, line_end = here.hexdigest(), at + cut
                        whole.update(block)
                        at += len(block)
                rows.append((r["file"], start, whole.hexdigest(), line_end, line, at_known))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "whole", "line_end", "line", "known"])

    return run


def _chain(before: Column, last: Column) -> Column:
    """Certificate of some whole ranges and the part of one more."""
    return F.sha2(F.concat_ws("", F.transform(before, lambda x: x["whole"]), F.coalesce(last, F.lit(""))).cast("binary"), 256)


def certified(files: DataFrame, path: str, hash_range: int = HASH_RANGE) -> DataFrame:
    """(file, size, known_frontier, frontier, prefix_hash, change) of ``files``.

    ``files``: file, size, and the known ``frontier`` and ``prefix_hash``, both null
    for new files. ``change``: cold, unchanged, append or replace. ``path``: any
    path of the file system that holds them. Bytes beyond ``size`` aren't read.
    """
    wanted = files.select("file", "size", "frontier", "prefix_hash")
    pieces = wanted.select("file", "size", "frontier", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(hash_range).cast("long"))).alias("start"))
    facts = _dealt(pieces, F.least(F.col("size") - F.col("start"), F.lit(hash_range))).mapInArrow(_hashed(path, hash_range), _FACTS)
    ranges = facts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "whole", "line_end", "line", "known"))).alias("ranges"))
    r = F.col("ranges")
    ended = F.filter(r, lambda x: x["line_end"].isNotNull())
    last = F.get(ended, F.size(ended) - 1)
    at_known = F.get(F.filter(r, lambda x: x["known"].isNotNull()), F.lit(0))
    upto = lambda part: F.filter(r, lambda x: x["start"] < part["start"])
    now = F.when(F.size(ended) > 0, _chain(upto(last), last["line"])).otherwise(EMPTY_HASH)
    then = F.when(F.col("known_frontier") == 0, EMPTY_HASH).when(at_known.isNotNull(), _chain(upto(at_known), at_known["known"]))
    both = wanted.withColumnsRenamed({"frontier": "known_frontier", "prefix_hash": "known_hash"}).join(ranges, "file")
    found = both.select("file", "size", "known_frontier", "known_hash", F.coalesce(last["line_end"], F.lit(0).cast("long")).alias("frontier"), now.alias("prefix_hash"), F.coalesce(then == F.col("known_hash"), F.lit(False)).alias("same"))
    change = (
        F.when(F.col("known_frontier").isNull(), "cold")
        .when(~F.col("same") | (F.col("size") < F.col("known_frontier")), "replace")
        .when(F.col("frontier") == F.col("known_frontier"), "unchanged")
        .when(F.endswith("file", F.lit(".zst")), "replace")
        .otherwise("append")
    )
    return found.withColumn("change", change).drop("same")


def _line_reader(path: str, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BoundedJsonlReader({"path": path, "maxBytes": max_bytes})
        for batch in batches:
            yield from reader.read(LineRanges([LineRange(r["file"], r["start"], r["stop"], r["floor"]) for r in batch.to_pylist()]))

    return run


def lines(files: DataFrame, path: str, max_bytes: int = MAX_RECORD_BYTES, line_range: int = LINE_RANGE) -> DataFrame:
    """(file, offset, value, oversized) of the lines in [floor, stop) of ``files``.

    ``stop`` is a line's end, ``floor`` too or 0. Ranges are rows, so reading is
    spread whatever the number of files; a ``.zst`` is read by one task.
    """
    packed = F.endswith("file", F.lit(".zst"))
    starts = F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.col("floor"), F.greatest(F.col("stop") - 1, F.col("floor")), F.lit(line_range).cast("long")))
    ranges = files.filter(packed | (F.col("stop") > F.col("floor"))).select("file", "floor", F.col("stop").alias("end"), F.explode(starts).alias("start"))
    size = F.least(F.col("end") - F.col("start"), F.lit(line_range))
    ranges = _dealt(ranges, size).select("file", "floor", "start", F.when(packed, -1).otherwise(F.least("end", F.col("start") + line_range)).cast("long").alias("stop"))
    return ranges.mapInArrow(_line_reader(path, max_bytes), BoundedJsonl({}).schema())
