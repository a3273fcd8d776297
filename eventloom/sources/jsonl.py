"""Line-delimited records as a Spark data source.

``spark.read.format("bounded_jsonl")`` plans byte ranges of files; a range
yields the lines that begin in it, with their byte offsets, so lines of a file
have an order whatever task read them. A last line without its end isn't a
record yet and is left for the next read; NUL padding at the end is dropped;
lines over ``maxBytes`` come as ``oversized`` without text. ``frontiers`` (JSON:
file to offset) resumes behind what earlier reads have certified. Files that
end in ``.zst`` are read whole by one task. A task reads as many small ranges as
``TASK_BYTES`` hold, so tasks grow with the bytes and not with the files.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
TASK_BYTES = 4 << 20  # ranges of a task, unless one range is more
OPEN_BYTES = 128 << 10  # what opening a file counts for
MAX_RECORD_BYTES = 64 << 20
BATCH_ROWS = 2000


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


class LineRange(InputPartition):
    def __init__(self, file: str, start: int, stop: int, floor: int):
        super().__init__((file, start, stop))
        self.file, self.start, self.stop, self.floor = file, start, stop, floor


class LineRanges(InputPartition):
    def __init__(self, ranges: list[LineRange]):
        super().__init__(ranges)
        self.ranges = ranges


class BoundedJsonl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bounded_jsonl"

    def schema(self) -> str:
        return "file string, offset long, value string, oversized boolean"

    def reader(self, schema) -> DataSourceReader:
        return BoundedJsonlReader(self.options)


class BoundedJsonlReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".jsonl,.jsonl.zst,.json").split(","))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.max_bytes = int(options.get("maxbytes", options.get("maxBytes", MAX_RECORD_BYTES)))
        self.depth = int(options.get("depth", 8))
        self.frontiers = json.loads(options.get("frontiers", "{}"))
        self.listed = json.loads(options.get("files", "null"))

    def _files(self) -> list[pafs.FileInfo]:
        """Plain files of a bounded tree; links aren't followed by the walk's depth."""
        fs, root = open_fs(self.path)
        if self.listed is not None:
            return sorted(fs.get_file_info([open_fs(f)[1] for f in self.listed]), key=lambda f: f.path)
        top = fs.get_file_info(root)
        if top.type == pafs.FileType.File:
            return [top]
        found, folders = [], [(root, 0)]
        while folders:
            folder, depth = folders.pop()
            for info in fs.get_file_info(pafs.FileSelector(folder)):
                if info.type == pafs.FileType.Directory and depth < self.depth:
                    folders.append((info.path, depth + 1))
                elif info.type == pafs.FileType.File and info.path.endswith(self.suffixes):
                    found.append(info)
        return sorted(found, key=lambda f: f.path)

    def _ranges(self) -> Iterator[tuple[LineRange, int]]:
        """Ranges of all files, with their bytes."""
        for f in self._files():
            if f.path.endswith(".zst"):
                yield LineRange(f.path, 0, -1, 0), f.size
                continue
            floor = int(self.frontiers.get(f.path, 0))
            for a in range(floor, f.size, self.range_bytes):
                stop = min(a + self.range_bytes, f.size)
                yield LineRange(f.path, a, stop, floor), stop - a

    def partitions(self) -> list[LineRanges]:
        tasks, held = [LineRanges([])], 0
        for part, size in self._ranges():
            held += size + OPEN_BYTES
            if tasks[-1].ranges and held > TASK_BYTES:
                tasks.append(LineRanges([]))
                held = size + OPEN_BYTES
            tasks[-1].ranges.append(part)
        return tasks

    def read(self, partition: LineRanges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in partition.ranges:
            for offset, line in self._lines(part):
                large = line is None or len(line) > self.max_bytes
                rows.append((part.file, offset, None if large else line.decode("utf-8", "replace"), large))
                if len(rows) >= BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "offset", "value", "oversized"])

    def _lines(self, part: LineRange) -> Iterator[tuple[int, bytes | None]]:
        fs, _ = open_fs(self.path)
        with fs.open_input_file(part.file) as raw:
            if part.stop < 0:
                import zstandard

                stream, at = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)), 0
            else:
                # A range that begins inside a line leaves that line to the range before.
                inside = part.start > part.floor
                raw.seek(part.start - inside)
                stream, at = io.BufferedReader(raw), part.start - inside
                if inside:
                    at += self._line(stream)[1]
            while part.stop < 0 or at < part.stop:
                line, size, ended = self._line(stream)
                if not ended:
                    return  # the end, or a record still being written
                if line is None:
                    yield at, None
                elif body := line.rstrip(b"\r\n").rstrip(b"\0"):
                    yield at, body
                at += size

    def _line(self, stream: io.BufferedReader) -> tuple[bytes | None, int, bool]:
        """The next line, its size with its end, and whether it has one.

        Of a line over ``maxBytes`` no more than that is held: it comes as None.
        """
        line = stream.readline(self.max_bytes + 2)
        size, ended = len(line), line.endswith(b"\n")
        if ended or size < self.max_bytes + 2:
            return line, size, ended
        while not ended and (more := stream.readline(1 << 20)):
            size, ended = size + len(more), more.endswith(b"\n")
        return None, size, ended


def read_records(spark: SparkSession, path: str, frontiers: dict[str, int] | None = None, **options) -> DataFrame:
    spark.dataSource.register(BoundedJsonl)
    reader = spark.read.format("bounded_jsonl").option("frontiers", json.dumps(frontiers or {}))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(path)


def read_files(spark: SparkSession, files: list[str], **options) -> DataFrame:
    """Records of the named files of one file system."""
    if not files:
        return spark.createDataFrame([], BoundedJsonl({}).schema())
    return read_records(spark, files[0], files=json.dumps(files), **options)


def split_oversized(records: DataFrame, policy: str = "reject_record") -> DataFrame:
    """Records of legal size; ``reject_source`` makes any oversized one an error."""
    if policy == "reject_record":
        return records.filter(~F.col("oversized"))
    kept = F.when(F.col("oversized"), F.raise_error(F.concat(F.lit("oversized record in "), F.col("file"))).cast("string")).otherwise(F.col("value"))
    return records.withColumn("value", kept)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, content) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), "content")


def classify(current: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change): cold, unchanged, append or replace, and removed.

    ``known``: path, frontier and prefix_hash (SHA-256 of the bytes before the
    frontier). A file that is at least as long with the same prefix was appended
    to, anything else is read anew.
    """
    was = known.select(F.col("path").alias("__path"), "frontier", "prefix_hash")
    both = current.join(was, F.col("path") == F.col("__path"), "full_outer")
    same = F.sha2(F.expr("substring(content, 1, cast(frontier as int))"), 256) == F.col("prefix_hash")
    change = (
        F.when(F.col("path").isNull(), "removed")
        .when(F.col("__path").isNull(), "cold")
        .when((F.col("size") < F.col("frontier")) | ~same, "replace")
        .when(F.col("size") == F.col("frontier"), "unchanged")
        .otherwise("append")
    )
    return both.select(F.coalesce("path", "__path").alias("path"), change.alias("change"))


def frontier_of(current: DataFrame) -> DataFrame:
    """What a manifest keeps of files read to their last complete line."""
    text = F.col("content").cast("string")
    whole = F.octet_length(F.substring_index(text, "\n", -1))
    end = (F.col("size") - whole).cast("long")
    return current.select("path", end.alias("frontier"), F.sha2(F.expr("substring(content, 1, cast(size as int))").substr(F.lit(1), end.cast("int")), 256).alias("prefix_hash"))
