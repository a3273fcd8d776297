"""Chat formatting by columnar byte assembly.

A conversation's turns become one text with marked turns and a mask of the
parts that training should learn. The template, per turn:

    <turn ROLE>\n TEXT \n</turn>\n

Inside roles and texts a backslash goes before every backslash, ``<`` and
``>``, so no text can look like a mark, and taking these away gives the text
back. A batch of turns is laid out at once: segment lengths are counted, their
running sums are the places, and headers and contents are scattered from the
columns' own buffers, a megabyte at a time, into one Arrow buffer allocated for
all, of which the bodies are slices. Ids are of any type that Spark sorts.

Rows of a conversation meet in one task in order of turn and are streamed: the
output is a part for each run of turns in a batch, with places in the whole, so
a conversation of any length needs the memory of a batch.

Defined results: null text and null role count as empty; the null conversation
is a conversation; turns of equal number go by role, then text; repeated rows
are turns of their own; an empty table gives no conversations; other columns
aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches

HEAD, HEAD_END, TAIL = b"<turn ", b">\n", b"\n</turn>\n"
ESCAPED = np.zeros(256, bool)
ESCAPED[[ord("\\"), ord("<"), ord(">")]] = True
LEARNED_ROLES = ("assistant",)
SLICE = 1 << 20
PART_SCHEMA = "conv_id long, part long, start long, n_turns long, body binary, loss array<struct<start:long,stop:long>>"


def _column_bytes(values) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as they lie in its Arrow buffer, and each value's length."""
    column = values if isinstance(values, pa.Array) else pa.array(values, pa.large_string())
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], np.diff(edges)


def _escapes_before(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes take an escape before each value's end, the start of the first included."""
    before, total = np.zeros(len(ends) + 1, np.int64), 0
    for a in range(0, len(data), SLICE):
        marks = np.cumsum(ESCAPED[data[a : a + SLICE]], dtype=np.int32)
        low, high = np.searchsorted(ends, [a, a + len(marks)], side="right")  # values that end in the slice
        at = ends[low:high] - a - 1
        before[low + 1 : high + 1] = total + marks[at]
        total += int(marks[-1])
    empty = np.flatnonzero(ends == 0)
    before[empty + 1] = 0
    return before


def _lay_out(buffer: np.ndarray, places: np.ndarray, data: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> None:
    """Copy the i-th value of ``data`` to ``places[i]`` of ``buffer``, a backslash before what takes one.

    ``SLICE`` bytes at a time, in a value or over many, so indices take the
    memory of a slice.
    """
    ends = np.cumsum(lengths)
    shift, total = places - (ends - lengths) - before[:-1], 0
    for a in range(0, len(data), SLICE):
        part = data[a : a + SLICE]
        marks = ESCAPED[part]
        first, last = np.searchsorted(ends, [a, a + len(part) - 1], side="right")
        held = np.minimum(ends[first : last + 1], a + len(part)) - np.maximum(ends[first : last + 1] - lengths[first : last + 1], a)
        to = np.arange(a + total, a + total + len(part)) + np.cumsum(marks) + np.repeat(shift[first : last + 1], held)
        buffer[to] = part
        buffer[to[marks] - 1] = ord("\\")
        total += int(marks.sum())


def _scatter(buffer: np.ndarray, places: np.ndarray, piece: bytes) -> None:
    """Copy ``piece`` to each of ``places``."""
    buffer[(places[:, None] + np.arange(len(piece))).ravel()] = np.tile(np.frombuffer(piece, np.uint8), len(places))


def assemble(roles, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(view of one Arrow buffer, start of each turn with the end last, text starts, text stops)."""
    (role, role_n), (text, text_n) = _column_bytes(roles), _column_bytes(texts)
    role_before, text_before = _escapes_before(role, np.cumsum(role_n)), _escapes_before(text, np.cumsum(text_n))
    role_size, text_size = role_n + np.diff(role_before), text_n + np.diff(text_before)
    total = len(HEAD) + role_size + len(HEAD_END) + text_size + len(TAIL)
    turn = np.concatenate([[0], np.cumsum(total)])
    role_at = turn[:-1] + len(HEAD)
    text_at = role_at + role_size + len(HEAD_END)
    buffer = np.frombuffer(pa.allocate_buffer(int(turn[-1])), np.uint8)
    for piece, at in ((HEAD, turn[:-1]), (HEAD_END, role_at + role_size), (TAIL, text_at + text_size)):
        _scatter(buffer, at, piece)
    _lay_out(buffer, role_at, role, role_n, role_before)
    _lay_out(buffer, text_at, text, text_n, text_before)
    return buffer, turn, text_at, text_at + text_size


_READ = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _batch(rows: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _cuts(ids: pa.Array) -> np.ndarray:
    """Where each run of equal ids begins, and the end; null equals null."""
    number = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    changed = number[1:] != number[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(ids)]])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before: tuple | None = None  # id, parts and bytes of the conversation that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        roles = batch.column(1)
        buffer, turn, text_at, text_end = assemble(roles, batch.column(2))
        cuts = _cuts(batch.column(0))
        ids, edges = batch.column(0).take(pa.array(cuts[:-1])), turn[cuts]
        part, place = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        if before is not None and before[0] == ids[0].as_py():
            part[0], place[0] = before[1:]
        before = (ids[-1].as_py(), part[-1] + 1, place[-1] + edges[-1] - edges[-2])
        learned = np.flatnonzero(pc.is_in(roles, value_set=pa.array(LEARNED_ROLES, roles.type)).to_numpy(zero_copy_only=False))
        run = np.searchsorted(cuts, learned, side="right") - 1
        shift = place[run] - edges[run]
        spans = pa.StructArray.from_arrays([pa.array(text_at[learned] + shift), pa.array(text_end[learned] + shift)], ["start", "stop"])
        loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(learned, cuts), pa.int32()), spans)
        if edges[-1] >= 1 << 31:
            raise ValueError("a batch of turns takes over 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        body = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(buffer)])
        columns = [ids, pa.array(part), pa.array(place), pa.array(np.diff(cuts)), body, loss]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "start", "n_turns", "body", "loss"])


def format_conversations(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Parts of formatted conversations, in order within their partition.

    (conv_id, part from 0, start: byte place of the part in the whole, n_turns,
    body: UTF-8 bytes, loss: byte spans of the whole that training learns).
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(quoted(id_column)).alias("conv_id"), F.col(quoted(turn_column)).alias("turn"), F.col(quoted(role_column)).cast("string").alias("role"), F.col(quoted(text_column)).cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format, PART_SCHEMA.replace("conv_id long", f"conv_id {rows.schema['conv_id'].dataType.simpleString()}", 1))


def unescaped(raw: bytes) -> bytes:
    out, at = [], 0
    while (i := raw.find(b"\\", at)) >= 0:
        out += [raw[at:i], raw[i + 1 : i + 2]]
        at = i + 2
    return b"".join([*out, raw[at:]])


def parse_part(body: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted part: marks can't stand in texts."""
    at = 0
    while at < len(body):
        if body[at : at + len(HEAD)] != HEAD:
            raise ValueError("no turn begins here")
        head = body.index(HEAD_END, at)
        while _odd_escapes(body, head):  # this one belongs to the role
            head = body.index(HEAD_END, head + 1)
        tail = body.index(TAIL, head + 1)
        yield unescaped(body[at + len(HEAD) : head]), unescaped(body[head + len(HEAD_END) : tail])
        at = tail + len(TAIL)


def _odd_escapes(body: bytes, at: int) -> bool:
    n = 0
    while at - n > 0 and body[at - n - 1 : at - n] == b"\\":
        n += 1
    return n % 2 == 1


class _Conversation:
    """Running digests of the conversation being read."""

    def __init__(self, conv_id: object):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.parts, self.bytes = 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, start: int, body: bytes, loss: list[dict]) -> None:
        for role, text in parse_part(body):
            self.turns += 1
            self.all.update(role + b"\n" + text + b"\n")
        for span in loss:
            text = unescaped(body[span["start"] - start : span["stop"] - start])
            self.loss.update(text)
            self.loss_chars += len(text.decode("utf-8", "surrogatepass"))
        self.chars += len(body.decode("utf-8", "surrogatepass"))
        self.parts, self.bytes = self.parts + 1, self.bytes + len(body)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now: _Conversation | None = None
    for batch in batches:
        kinds, done = [batch.schema.field(0).type, *_READ], []
        ids, parts, starts, _, bodies, losses = (c.to_pylist() for c in batch.columns)
        for conv_id, part, start, body, loss in zip(ids, parts, starts, bodies, losses, strict=True):
            if part == 0:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            if now is None or (conv_id, part, start) != (now.conv_id, now.parts, now.bytes):
                raise ValueError("parts of a conversation are missing or out of order")
            now.add(start, body, loss)
        yield _batch(done, kinds, names)
    if now is not None:
        yield _batch([now.row()], kinds, names)


def read_back(parts: DataFrame, ordered: bool = True) -> DataFrame:
    """Digests of conversations, read from formatted parts.

    ``ordered``: the parts stand as ``format_conversations`` leaves them. Without
    it, as for parts read from files, they are brought together and sorted first.
    A part that is missing or out of place is an error.
    """
    if not ordered:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = parts.schema["conv_id"].dataType.simpleString()
    return parts.mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
