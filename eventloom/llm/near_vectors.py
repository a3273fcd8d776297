"""Near duplicates among embeddings: all pairs with a cosine at or over a threshold.

1. *Copies.* Equal vectors are one node with a weight: a vector that a third of
   all rows share costs no more than one.
2. *Blocks.* ``PIVOTS`` vectors (those with the smallest hashes of their ids: a
   bounded sample that only speeds up) cut the sphere in cells; nodes of like
   angle to the same nearest pivot go to blocks of at most about ``BLOCK_ROWS``.
   For every pivot a block knows its least and greatest angle. By the triangle
   inequality two blocks can't hold a link if some pivot sees them further apart
   than the threshold's angle, and are linked throughout if the greatest angles to
   some pivot add up to less than it. Neither needs a product.
3. *Tiles.* For all other pairs of blocks the unit vectors, quantised to 8 bits
   (u = s * q + r, |r| = e), are multiplied as tiles. The product of whole
   numbers is exact, so a cosine differs from s * t * (q . p) by at most
   e + f + e * f. Pairs surely over the threshold are links, pairs surely below it
   are none; only those in between are computed again from the components in
   double precision. Nothing is approximate.
4. A task adds up its links per node and hands over a forest instead of pairs, so
   a large family of near copies gives no more rows than it has members.
   Components are found over the forests by joins.

Units of ``UNIT_BLOCKS`` blocks meet in one task, so a block is sent once for each
unit that can hold a link with it. Vectors of unrelated directions give no pivot a
view apart: all units meet then, and the work grows with the square of the rows,
as all pairs have to be ruled out.

Defined results: null and zero vectors and those with null or non-finite components
have no links and are their own component; vectors of different lengths aren't
linked; repeated rows are linked copies; rows without an id take part, and a
component is named by its least id that isn't null (null if there is none);
``kept`` is true where a row's id is its component's; an empty table gives an empty
result; other columns pass through unless they carry an added name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, packed, quoted, skew_join, staged, unpacked
from .graph import components

THRESHOLD = 0.9
PIVOTS = 64
ANGLE_BINS = 32
BLOCK_ROWS = 4096
BLOCK_BYTES = 2 << 20
UNIT_BLOCKS = 4
TILE = 1024
SUMMARY_CHUNK = 512
#: Angles and estimates are trusted up to this.
SLACK = 1e-6
ADDED = ["n_links", "component_id", "kept"]


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors in doubles, each times a power of two that brings it near 1: squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q in 8 bits, s, bound of |u - s * q|) of unit vectors."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    rest = u - s[:, None] * q
    return q, s, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-12


def angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


class Block:
    """A block's vectors; ``low`` and ``high``: its angles to the pivots of its length."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> None:
        self.nodes, self.weights, self.x = nodes, weights, x
        u = unit(x)
        self.q, self.s, self.e = quantised(u)
        seen = angles(u, pivots) if len(pivots) else np.empty((len(u), 0))
        self.low, self.high = (seen.min(axis=0), seen.max(axis=0)) if len(pivots) else (np.empty(0), np.empty(0))


def apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, limit: float) -> np.ndarray:
    """Whether some pivot sees the two further apart than ``limit``; over the last axis."""
    return (np.maximum(low_a - high_b, low_b - high_a) > limit + SLACK).any(axis=-1)


class Forest:
    """Nodes 0..n-1, each with the least node it is known to be tied to."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.up[a], self.up[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = self.up[self.up]
                if (further == self.up).all():
                    break
                self.up = further


class Comparison:
    """Links between blocks: per node the weight it is linked with, and a forest."""

    def __init__(self, blocks: list[Block], threshold: float = THRESHOLD) -> None:
        self.blocks, self.threshold, self.limit = blocks, threshold, math.acos(threshold)
        self.first = np.concatenate([[0], np.cumsum([len(b.nodes) for b in blocks])])
        self.links = np.zeros(self.first[-1], np.int64)
        self.forest = Forest(self.first[-1])
        self.done = {"apart": 0, "whole": 0, "multiplied": 0, "pairs": 0, "sure": 0, "computed": 0}

    def compare(self, i: int, j: int) -> None:
        """Blocks i and j; with i = j the pairs inside."""
        a, b = self.blocks[i], self.blocks[j]
        if a.x.shape[1] != b.x.shape[1] or (i != j and bool(apart(a.low, a.high, b.low, b.high, self.limit))):
            self.done["apart"] += 1
        elif len(a.high) and (a.high + b.high).min() < self.limit - SLACK:
            self.done["whole"] += 1
            ia, ib = np.arange(self.first[i], self.first[i + 1]), np.arange(self.first[j], self.first[j + 1])
            self.links[ia] += b.weights.sum() - (a.weights if i == j else 0)
            if i != j:
                self.links[ib] += a.weights.sum()
                self.forest.tie(ib, np.full(len(ib), ia[0]))
            self.forest.tie(ia, np.full(len(ia), ib[0]))
        else:
            self.done["multiplied"] += 1
            self._multiply(i, j)

    def _multiply(self, i: int, j: int) -> None:
        a, b = self.blocks[i], self.blocks[j]
        kind = np.float32 if a.q.shape[1] <= 1024 else np.float64  # sums of products stay whole numbers below 2 ** 24 (2 ** 53)
        qa, qb = a.q.astype(kind), b.q.astype(kind)
        for r in range(0, len(qa), TILE):
            for c in range(r if i == j else 0, len(qb), TILE):
                rows, cols = slice(r, r + TILE), slice(c, c + TILE)
                product = qa[rows] @ qb[cols].T
                s, e, t, f = a.s[rows], a.e[rows], b.s[cols], b.e[cols]
                self.done["pairs"] += product.size
                highest = s * t.max() * product.max(axis=1) + e + f.max() + e * f.max()
                some = np.flatnonzero(highest >= self.threshold - SLACK)
                if not len(some):
                    continue
                estimate = product[some] * (s[some, None] * t)
                room = e[some, None] + f + e[some, None] * f
                possible = estimate + room >= self.threshold - SLACK
                if i == j and r == c:
                    possible &= some[:, None] < np.arange(len(t))
                x, y = np.nonzero(possible)
                sure = estimate[x, y] - room[x, y] >= self.threshold + SLACK
                x, y = some[x] + r, y + c
                again = np.flatnonzero(~sure)
                self.done["sure"] += len(x) - len(again)
                self.done["computed"] += len(again)
                for k in range(0, len(again), 1 << 16):
                    part = again[k : k + (1 << 16)]
                    sure[part] = cosines(a.x[x[part]], b.x[y[part]]) >= self.threshold
                self._link(x[sure] + self.first[i], y[sure] + self.first[j])

    def _link(self, x: np.ndarray, y: np.ndarray) -> None:
        if not len(x):
            return
        weights = np.concatenate([b.weights for b in self.blocks])
        np.add.at(self.links, x, weights[y])
        np.add.at(self.links, y, weights[x])
        self.forest.tie(x, y)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, other node or -1, links): a node's links, or with 0 a tie of the forest."""
        nodes = np.concatenate([b.nodes for b in self.blocks])
        some, tied = np.flatnonzero(self.links), np.flatnonzero(self.forest.up != np.arange(len(nodes)))
        return (
            np.concatenate([nodes[some], nodes[tied]]),
            np.concatenate([np.full(len(some), -1), nodes[self.forest.up[tied]]]),
            np.concatenate([self.links[some], np.zeros(len(tied), np.int64)]),
        )


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows, in double precision from the components."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def valid(vector: Column) -> Column:
    """Whether a vector has a direction: no null, no infinity or NaN, not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _of_length(pivots: list[np.ndarray], n: int) -> np.ndarray:
    same = [p for p in pivots if len(p) == n]
    return np.stack(same) if same else np.empty((0, n))


def _placer(pivots: list[np.ndarray]):
    """(node, weight, vector) with the vector's length, nearest pivot and bin of the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            cell, place = np.full(len(sizes), -1, np.int32), np.zeros(len(sizes), np.int32)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                near = _of_length(pivots, n)
                if len(near):
                    seen = angles(unit(_matrix(vectors.take(pa.array(at)))), near)
                    cell[at] = seen.argmin(axis=1)
                    place[at] = np.minimum(seen.min(axis=1) / np.pi * ANGLE_BINS, ANGLE_BINS - 1)
            own = [pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "size", "cell", "bin"])

    return run


def _blocks_of(bins: list, block_rows: int) -> list[tuple[int, int, int, int, int]]:
    """(size, cell, bin, first block, blocks): neighbouring bins share a block, large bins have many."""
    out, block, filled, last = [], -1, 0, None
    for r in bins:
        if r["n"] > block_rows:
            parts = -(-r["n"] // block_rows)
            out.append((r["size"], r["cell"], r["bin"], block + 1, parts))
            block, last = block + parts, None
            continue
        if last != r["size"] or filled + r["n"] > block_rows:
            block, filled, last = block + 1, 0, r["size"]
        filled += r["n"]
        out.append((r["size"], r["cell"], r["bin"], block, 1))
    return out


_BLOCK = "block int, size int, rows int, unit int, nodes binary, weights binary, x binary, low binary, high binary"


def _packed_blocks(pivots: list[np.ndarray], kind: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        x = np.ascontiguousarray(_matrix(table["vector"].combine_chunks()), dtype=kind)
        b = Block(table["node"].to_numpy(), table["weight"].to_numpy(), x, _of_length(pivots, x.shape[1]))
        block = key[0].as_py()
        row = {"block": block, "size": x.shape[1], "rows": len(x), "unit": block // UNIT_BLOCKS, "nodes": b.nodes.tobytes(), "weights": b.weights.tobytes(), "x": x.tobytes(), "low": b.low.tobytes(), "high": b.high.tobytes()}
        kinds = {"block": pa.int32(), "size": pa.int32(), "rows": pa.int32(), "unit": pa.int32()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

    return run


def _near_units(threshold: float):
    """Pairs of units that hold a pair of blocks that aren't apart, of two chunks of block summaries."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, (a, b) = table.to_pylist(), (k.as_py() for k in key)
        sides = [[r for r in rows if r["block"] // SUMMARY_CHUNK == c] for c in (a, b)]
        found = set()
        for size in {r["size"] for r in rows}:
            one, two = ([r for r in side if r["size"] == size] for side in sides)
            if not one or not two:
                continue
            low, high = (np.stack([np.frombuffer(r[n]) for r in two]) for n in ("low", "high"))
            other = np.array([r["unit"] for r in two])
            for r in one:
                near = ~apart(np.frombuffer(r["low"]), np.frombuffer(r["high"]), low, high, math.acos(threshold))
                found |= {(min(r["unit"], u), max(r["unit"], u)) for u in np.unique(other[near]).tolist()}
        found = sorted(found)
        return pa.table({"ua": pa.array([x for x, _ in found], pa.int32()), "ub": pa.array([y for _, y in found], pa.int32())})

    return run


def _linked(kind: str, pivots: list[np.ndarray], threshold: float):
    """The links between the blocks of two units."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        blocks = [
            Block(np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["weights"], np.int64), np.frombuffer(r["x"], kind).reshape(r["rows"], r["size"]), _of_length(pivots, r["size"]))
            for r in rows
        ]
        c = Comparison(blocks, threshold)
        a, b = (k.as_py() for k in key)
        for i, x in enumerate(rows):
            for j in range(i, len(rows)):
                if (x["unit"], rows[j]["unit"]) == (a, b):
                    c.compare(i, j)
        return pa.table(dict(zip(("node", "other", "links"), map(pa.array, c.rows()), strict=True)))

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, ``n_links`` (other rows linked directly), ``component_id``
    (least id reachable by links) and ``kept`` (the id is the component's).

    ``threshold`` is in (0, 1).
    """
    spark = vectors.sparkSession
    kind = "f4" if isinstance(vectors.schema[vector_column].dataType.elementType, T.FloatType) else "f8"
    whole = T.FloatType() if kind == "f4" else T.DoubleType()
    columns = kept_columns(vectors, keep, ADDED)
    vector, row_id = F.col(quoted(vector_column)).cast(T.ArrayType(whole)), F.col(quoted(id_column))
    rows = vectors.select(row_id.alias("id"), vector.alias("vector"), packed(columns))
    sound = rows.filter(valid(F.col("vector")))
    drawn = sound.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = [unit(np.array([p]))[0] for p in dict.fromkeys(tuple(r["vector"]) for r in drawn)]
    copies = sound.groupBy("vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = staged(copies.withColumn("node", F.monotonically_increasing_id()), "nodes")

    id_type = rows.schema["id"].dataType
    kinds = {"node": T.LongType(), "weight": T.LongType(), "vector": T.ArrayType(whole), "size": T.IntegerType(), "cell": T.IntegerType(), "bin": T.IntegerType()}
    placed = nodes.select("node", "weight", "vector").mapInArrow(_placer(pivots), T.StructType([T.StructField(n, t) for n, t in kinds.items()]))
    placed = staged(placed, "placed")
    bins = placed.groupBy("size", "cell", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("longest")).orderBy("size", "cell", "bin").collect()
    longest = max((r["size"] for r in bins), default=1)
    block_rows = max(TILE // 16, min(BLOCK_ROWS, BLOCK_BYTES // (longest * (1 + int(kind[1])))))
    dealt = _blocks_of(bins, block_rows)
    n_blocks = max((first + parts for *_, first, parts in dealt), default=0)

    deal = spark.createDataFrame(dealt, "size int, cell int, bin int, first int, parts int")  # at most PIVOTS * ANGLE_BINS rows a vector length
    numbered = placed.join(F.broadcast(deal), ["size", "cell", "bin"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    numbered = numbered.select("block", "node", "weight", "vector")
    blocks = staged(numbered.groupBy("block").applyInArrow(_packed_blocks(pivots, kind), _BLOCK), "blocks")

    chunks = F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0) // SUMMARY_CHUNK))
    own = F.floor(F.col("block") / SUMMARY_CHUNK).cast("int")
    meetings = blocks.select("block", "size", "unit", "low", "high", F.explode(F.transform(chunks, lambda c: F.struct(F.least(c, own).alias("a"), F.greatest(c, own).alias("b")))).alias("meeting"))
    pairs = meetings.groupBy("meeting.a", "meeting.b").applyInArrow(_near_units(threshold), "ua int, ub int").distinct()
    pairs = staged(pairs, "pairs")
    sent = pairs.select("ua", "ub", F.explode(F.array_distinct(F.array("ua", "ub"))).alias("unit")).join(blocks, "unit")
    tasks = max(1, min(pairs.count(), 1 << 14))
    links = staged(sent.repartition(tasks, "ua", "ub").groupBy("ua", "ub").applyInArrow(_linked(kind, pivots, threshold), "node long, other long, links long"), "links")

    degree = links.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(links.filter("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    members = tied.join(nodes.select("node", "least"), "node")
    named = members.groupBy("component").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("members"))
    names = skew_join(members.select("node", "component"), named, ["component"], "members").select("node", "name")
    of_node = nodes.join(degree, "node", "left").join(names, "node", "left")
    table = of_node.select("vector", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "least").alias("component_id"))
    joined = skew_join(sound, staged(table, "named"), ["vector"], "weight")
    alone = rows.filter(~valid(F.col("vector"))).select("*", F.lit(0).cast("long").alias("n_links"), F.col("id").cast(id_type).alias("component_id"))
    every = joined.select("id", "vector", "kept", "n_links", "component_id").unionByName(alone)
    return every.select(*unpacked(columns), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
