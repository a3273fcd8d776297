"""Media columns over archive directories.

Payloads are stored as 8-bit samples in grey PNG images, members of plain tar
archives in a shared directory. The data source ``media_archive`` plans byte
ranges of the archives, so a large archive is read by many tasks; a task finds
the first member header in its range by the tar grid, its checksum and the
archive's own name, follows the sizes from there, and reads every member on its
own by offset: one that can't be read or decoded is tried again from its
offset with a new handle, whatever became of the others. Members stream through
Arrow batches of bounded size.

Archives are written by tasks under names of their own; only those of tasks
that succeeded are in the manifest, and others are deleted before reading.

Defined results: null and empty texts are stored as one row of spaces; repeated
rows are members of their own, equal texts have equal samples and stored bytes;
a null id stays null; an empty table gives an empty result; a member that fails
every attempt fails the job, so that nothing is lost in silence.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import quoted, small_batches, staged

WIDTH = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
MOST_RANGES = 100_000  # planned on the driver; beyond that ranges grow with the input
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
BLOCK = 512
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def padded(raw: bytes) -> bytes:
    """``raw`` and spaces up to a positive multiple of the width."""
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit image of the payload, a sample a byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that ``to_png`` made; ValueError if it is damaged."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG image")
    at, size, body = 8, None, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if size is None or size[2:4] != (8, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def _add(stream, name: str, body: bytes) -> int:
    info = tarfile.TarInfo(name)
    info.size = len(body)
    return stream.write(info.tobuf(tarfile.USTAR_FORMAT) + body + b"\0" * (-len(body) % BLOCK))


def _write(path: str):
    def listed(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["archive", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        stream, stem, held, members = None, "", 0, 0
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream is None:
                    stem, held, members = uuid.uuid4().hex, 0, 0
                    stream = fs.open_output_stream(f"{root}/{stem}.tar")
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                body = to_png(padded(raw))
                name = "" if key is None else "i" + base64.urlsafe_b64encode(key.encode()).decode()
                if len(name) > MOST_NAME:  # in a member of its own before the image
                    held += _add(stream, f"{stem}/{ID_MEMBER}", name.encode())
                    name = ID_BEFORE
                held, members = held + _add(stream, f"{stem}/{name}/{len(raw)}.png", body), members + 1
                if held >= ARCHIVE_BYTES:
                    stream.write(b"\0" * 2 * BLOCK)
                    stream.close()
                    stream = None
                    done.append((f"{stem}.tar", members))
            yield listed(done)
        if stream is not None:
            stream.write(b"\0" * 2 * BLOCK)
            stream.close()
            yield listed([(f"{stem}.tar", members)])

    return run


def write_archives(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Store every row's text as a member of an archive under ``path``."""
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_column)).cast("string").alias("id"), F.col(quoted(text_column)).cast("string").alias("text"))
    manifest = staged(rows.mapInArrow(_write(path), "archive string, members long"), "archives")
    committed = {r["archive"] for r in manifest.select("archive").collect()}  # one a task or 64 MB
    for found in fs.get_file_info(pafs.FileSelector(root)):
        if found.base_name.endswith(".tar") and found.base_name not in committed:
            fs.delete_file(found.path)


#: Names longer than this would not fit an archive's header beside the rest.
MOST_NAME = 48
ID_MEMBER, ID_BEFORE = "id", "@"
SEARCH_BYTES = 1 << 20


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, stop: int, size: int):
        super().__init__((archive, start, stop))
        self.archive, self.start, self.stop, self.size = archive, start, stop, size


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(directory)``.

    Options: ``rangeBytes`` (of archive a task), ``attempts`` (for a member).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaArchiveReader(self.options)


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = max(BLOCK, int(options.get("rangeBytes", RANGE_BYTES)) // BLOCK * BLOCK)
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[ByteRange]:
        fs, root = open_fs(self.path)
        found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".tar")]
        step = max(self.range_bytes, -(-sum(f.size for f in found) // (MOST_RANGES * BLOCK)) * BLOCK)
        ranges = [ByteRange(f.path, a, min(a + step, f.size), f.size) for f in found for a in range(0, f.size, step)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        names = ["archive", "offset", "name", "media"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
        rows, held = [], 0
        for offset, name, media in self._members(fs, partition) if partition.size else ():
            rows.append((partition.archive, offset, name, media))
            held += len(media)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def _members(self, fs, part: ByteRange) -> Iterator[tuple[int, str, bytes]]:
        """Members whose header begins in the range."""
        stem = part.archive.rsplit("/", 1)[-1].removesuffix(".tar") + "/"
        at, synced = part.start, part.start == 0
        if not synced:  # the range before has the member that goes on here
            at = self._next_header(fs, part, stem)
        while at < part.stop:
            head = self._tried(fs, part.archive, at, BLOCK, lambda raw: self._header(raw, stem, True))
            if head is None:
                return  # the archive's end
            begin, after = at, at + BLOCK + -(-head.size // BLOCK) * BLOCK
            if head.name == stem + ID_MEMBER:  # with the image that it belongs to, wherever that is
                key = self._tried(fs, part.archive, at + BLOCK, head.size, bytes.decode)
                at = after
                head = self._tried(fs, part.archive, at, BLOCK, lambda raw: self._header(raw, stem, True))
                name = f"{stem}{key}/{head.name.rsplit('/', 1)[-1]}"
                after = at + BLOCK + -(-head.size // BLOCK) * BLOCK
            elif head.name.startswith(f"{stem}{ID_BEFORE}/"):
                at = after  # read by the range that holds its id
                continue
            else:
                name = head.name
            yield begin, name, self._tried(fs, part.archive, at + BLOCK, head.size, self._whole)
            at = after

    def _next_header(self, fs, part: ByteRange, stem: str) -> int:
        """Where the first header in the range is; its end if there is none."""
        at = part.start
        while at < part.stop:
            blocks = self._tried(fs, part.archive, at, min(SEARCH_BYTES, part.size - at), bytes)
            for i in range(0, min(len(blocks), part.stop - at), BLOCK):
                if self._header(blocks[i : i + BLOCK], stem, False) is not None:
                    return at + i
            at += SEARCH_BYTES
        return part.stop

    @staticmethod
    def _header(raw: bytes, stem: str, synced: bool) -> tarfile.TarInfo | None:
        """The header in ``raw``; None at the end, or before the first is found."""
        if raw.count(0) == BLOCK:
            return None
        try:
            info = tarfile.TarInfo.frombuf(raw, "utf-8", "strict")
        except (tarfile.HeaderError, UnicodeDecodeError):
            if synced:
                raise ValueError("damaged header") from None
            return None
        if info.name.startswith(stem):
            return info
        if synced:
            raise ValueError("foreign header")
        return None

    @staticmethod
    def _whole(raw: bytes) -> bytes:
        from_png(raw)
        return raw

    def _tried(self, fs, archive: str, offset: int, size: int, check):
        """``check`` of the bytes at ``offset``; anew from there if that fails."""
        for attempt in range(self.attempts):
            try:
                if attempt or getattr(self, "_open", (None,))[0] != archive:
                    self._open = (archive, fs.open_input_file(archive))
                self._open[1].seek(offset)
                raw = self._open[1].read(size)
                if len(raw) != size:
                    raise ValueError("cut short")
                return check(raw)
            except (OSError, ValueError, struct.error, zlib.error) as error:
                failure = error
        raise RuntimeError(f"{archive}, offset {offset}: {failure}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").load(path)


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy and mean step between neighbours."""
    flat = samples.ravel()
    share = np.bincount(flat, minlength=256) / flat.size
    known = share[share > 0]
    step = np.abs(np.diff(samples.astype(np.int16), axis=1)).mean()
    return f"{samples.shape[1]}x{samples.shape[0]};mean={flat.mean():.4f};std={flat.std():.4f};entropy={-(known * np.log2(known)).sum():.4f};step={step:.4f}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, key, last = name.split("/")
            samples = from_png(media)
            payload = samples.tobytes()
            rows.append((base64.urlsafe_b64decode(key[1:]).decode() if key else None, int(last.split(".")[0]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def media_features(members: DataFrame, id_column: str = "doc_id", id_type: str = "long") -> DataFrame:
    """Digests and features of the members of ``read_archives``, from their stored bytes.

    Ids are kept as text in member names; ``id_type`` is what they are read as.
    """
    small_batches(members.sparkSession, 500)
    found = members.select("name", "media").mapInArrow(_features, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_column)
