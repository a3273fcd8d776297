"""Files that grow, as a stream that loses nothing.

The source ``changed_files`` watches a folder: its offset is a map of file to
size and time of change, and a micro-batch holds the files whose entry differs.
That only says where to look. What is new in a file is decided against the frontier
in the store's active generation (``sources.frontiers``): new lines behind an
unchanged prefix are appended, rewritten files are replaced whole, and a batch that
is run again finds nothing new. So progress belongs to the store and not to a
stream: two streams, a new checkpoint or publications in between change nothing.

Each file is one source. A source that fails keeps its rows and frontier, and is
read again when its file changes or at the next ``reconcile``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..snapshots import Snapshots
from ..sources import frontiers
from ..sources.jsonl import split_oversized

QUIET_MS = 250
FILES_PER_TASK = 1000


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return frontiers.FILES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangedFilesReader(self.options)


class FileEntries(InputPartition):
    def __init__(self, entries: list[tuple[str, int, int]]):
        super().__init__(entries)
        self.entries = entries


class ChangedFilesReader(DataSourceStreamReader):
    """Offsets are {file: "size:time"}; files that are gone are left to ``reconcile``."""

    def __init__(self, options):
        self.path, self.suffixes, self.depth = options["path"], options.get("suffixes", ".jsonl,.jsonl.zst,.json"), int(options.get("depth", 8))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: f"{size}:{changed}" for f, size, changed in frontiers.list_files(self.path, self.suffixes, self.depth)}

    def partitions(self, start: dict, end: dict) -> list[FileEntries]:
        new = sorted((f, *map(int, mark.split(":"))) for f, mark in end.items() if start.get(f) != mark)
        return [FileEntries(new[i : i + FILES_PER_TASK]) for i in range(0, len(new), FILES_PER_TASK)]

    def read(self, partition: FileEntries) -> Iterator[tuple]:
        yield from partition.entries


def watch(spark: SparkSession, path: str, suffixes: str = ".jsonl,.jsonl.zst,.json", depth: int = 8) -> DataFrame:
    """The files of a folder as they appear and change: file, size, modified."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").option("suffixes", suffixes).option("depth", str(depth)).load(path)


Parse = Callable[[DataFrame], DataFrame]


def refresh_files(
    store: Snapshots,
    files: DataFrame,
    path: str,
    parse: Parse,
    source_key: Callable[[Column], Column] = lambda file: file,
    checks: dict[str, Column] | None = None,
    context_bytes: int = 0,
    absent: Callable[[DataFrame], list[str]] | None = None,
    **limits,
) -> DataFrame | None:
    """Bring the store up to what ``files`` (file, size) hold; the verdicts, None if nothing is new.

    ``parse`` turns records (file, offset, value) into events whose source is
    ``source_key`` of their file; offsets are those of the whole file, so events
    have the ids that a batch import gives them. ``context_bytes``: lines that begin
    in so many first bytes of a file go through ``parse`` with appended lines as
    well, for formats whose first lines describe a session; what they give is
    known already and left out.
    """
    known = store.frontiers()
    keyed = files.select("file", "size").withColumn("source_key", source_key(F.col("file"))).join(known, "source_key", "left")
    # A file is looked at once: what was seen is written down before it is used.
    seen = frontiers.certified(keyed, path).withColumn("source_key", source_key(F.col("file")))
    seen = _written(store, seen, "frontiers")
    changed = seen.filter("change <> 'unchanged'")
    gone = absent(seen) if absent else []
    if not gone and changed.isEmpty():
        return None
    floor = F.when(F.col("change") == "append", F.col("known_frontier")).otherwise(0).cast("long")
    spans = changed.select("file", floor.alias("floor"), F.col("frontier").alias("stop"))
    read = lambda spans: split_oversized(frontiers.lines(spans, path, **limits))
    events = parse(read(spans))
    if context_bytes:
        before = spans.filter("floor > 0").select("file", F.lit(0).cast("long").alias("floor"), F.col("floor").alias("stop"))
        context = read(before).filter(F.col("offset") < context_bytes)
        old = parse(context).select("event_id")
        events = parse(read(spans).unionByName(context)).join(old, "event_id", "left_anti")
    routes = changed.select("source_key", "change", "frontier", "prefix_hash", "known_frontier", "known_hash")
    verdicts = None if changed.isEmpty() else store.publish_routes(events, routes, checks)[1]
    if gone:
        store.publish(absent=gone)
    return verdicts


def _written(store: Snapshots, rows: DataFrame, name: str) -> DataFrame:
    path = store.work_path(name)
    rows.write.parquet(path)
    return store.spark.read.schema(rows.schema).parquet(path)


def refresh(store: Snapshots, path: str, parse: Parse, checkpoint: str, once: bool = True, suffixes: str = ".jsonl,.jsonl.zst,.json", **options) -> StreamingQuery:
    """Publish what is new in a folder, micro-batch by micro-batch."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        refresh_files(store, batch, path, parse, **options)

    writer = watch(store.spark, path, suffixes).writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=f"{QUIET_MS} milliseconds").start()


def reconcile(store: Snapshots, path: str, parse: Parse, suffixes: str = ".jsonl,.jsonl.zst,.json", **options) -> DataFrame | None:
    """Exact comparison of a whole folder with the store, whatever streams have seen.

    Sources that were read by frontier and whose files are gone count as absent
    once more; the store drops them after ``snapshots.GRACE_ABSENCES`` times.
    """

    def absent(seen: DataFrame) -> list[str]:
        return [r["source_key"] for r in store.frontiers().join(seen, "source_key", "left_anti").select("source_key").collect()]

    return refresh_files(store, frontiers.listed(store.spark, path, suffixes), path, parse, absent=absent, **options)
