"""A term index that grows with a snapshot store, and searches that skip most of it.

Every publication writes new folders of events; ``update`` indexes only those, as one
immutable *segment*. Nothing in a segment is ever changed: a posting lives as long
as the generation that is searched refers to its folder, so replaced and deleted
sources leave tombstones without a write. Segments of like size are merged four at
a time (their postings are read, no text), which drops what is dead. Numbers of
events, lengths and frequencies are sums over the live parts of all segments.

A segment holds *blocks*: the postings of a term within a stripe, a group of about
``STRIPE`` events of one folder that are about equally long and lead with the same
terms. A block's greatest
frequency and least length bound what it can add to a score, so the sum of these
bounds over a query's terms bounds every event of a stripe. A search reads the
columns with the bounds, then in rounds the blocks of the stripes that promise most,
and at last only those stripes whose bound reaches the pool's last score. Blocks are sorted by term and length, so what is skipped is not decoded.

Lengths are kept in one byte: exact up to 40, beyond that to four binary digits.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import B, K1, class_weight, length_code, length_of_code, term_counts, tokens
from ..snapshots import Snapshots
from .projections import body_search
from .search import POOL

STRIPE = 64
BUCKETS = 16
POSTINGS_PER_TASK = 1 << 20
LEADS = 1 << 16
SLICE = 1 << 18  # postings whose blocks are made at once
MERGE = 4  # segments of one tier that become one
WIDTH = 4  # a tier is so many times larger than the one below
SLACK = 1e-9
ROUNDS = (16, 64)  # stripes that are read first, and next, to raise the pool's last score
BLOCK = "folder string, stripe string, norm_class int, term string, n long, max_tf long, min_norm int, event_ids array<string>, tfs array<long>, norms array<int>, bucket int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of events in order of their stripes; one that goes on in the next slice is two."""
    names = ["folder", "stripe", "norm_class", "term", "n", "max_tf", "min_norm", "event_ids", "tfs", "norms"]
    for batch in batches:
        ends, start = np.cumsum(pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            part, start = batch.slice(start, stop - start), stop
            of = pc.list_parent_indices(part["terms"])
            stripe = part["stripe"].dictionary_encode().indices
            rows = pa.table({"s": stripe.take(of), "term": part["terms"].flatten(), "tf": part["tfs"].flatten().cast(pa.int64()), "norm": part["norm"].take(of), "event": part["event_id"].take(of)})
            made = rows.group_by(["s", "term"], use_threads=False).aggregate([("tf", "count"), ("tf", "max"), ("norm", "min"), ("event", "list"), ("tf", "list"), ("norm", "list")]).combine_chunks()
            first = pa.array(np.unique(stripe.to_numpy(zero_copy_only=False), return_index=True)[1]).take(made["s"].combine_chunks())
            columns = [part[c].take(first) for c in names[:3]] + [made[c].combine_chunks() for c in ("term", "tf_count", "tf_max", "norm_min", "event_list", "tf_list", "norm_list")]
            yield pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Segment:
    name: str
    postings: int
    folders: dict[str, list[int]]  # folder: events, sum of their lengths

    @property
    def tier(self) -> int:
        return int(math.log(max(self.postings, 1), WIDTH))


@dataclass
class Found:
    """A pool of events with ``coverage`` and ``score``, and what it cost."""

    pool: DataFrame
    blocks: int
    blocks_read: int


class SegmentedIndex:
    """The index of one generation of a store."""

    def __init__(self, store: Snapshots, generation: str, segments: list[Segment], written: int = 0):
        """``written``: postings that indexing this generation added."""
        self.store, self.generation, self.segments, self.written = store, generation, segments, written
        self.live = {p for s in store.generation(generation).sources.values() for p in s.paths}
        self.spark = store.spark
        facts = [n for s in segments for folder, n in s.folders.items() if folder in self.live]
        self.n_docs, self.total_length = sum(n for n, _ in facts), sum(length for _, length in facts)

    # -- keeping -----------------------------------------------------------
    @staticmethod
    def _known(store: Snapshots, generation: str | None) -> list[Segment]:
        """Segments of the nearest generation, this or an earlier one, that was indexed."""
        while generation is not None:
            text = store._read(f"term-segments/{generation}.json")
            if text is not None:
                return [Segment(**s) for s in json.loads(text)["segments"]]
            try:
                generation = store.generation(generation).parent
            except ValueError:  # reclaimed
                return []
        return []

    @staticmethod
    def update(store: Snapshots, generation: str | None = None) -> SegmentedIndex:
        """The index of a generation (default: the active one), brought up to date.

        The list of segments is written last, aside and renamed: a crash leaves
        segments that nothing refers to, and two updates at once each have theirs.
        """
        generation = generation or store.active()
        if generation is None:
            raise ValueError("nothing has been published")
        segments = SegmentedIndex._known(store, generation)
        text = store._read(f"term-segments/{generation}.json")
        if text is not None:
            return SegmentedIndex(store, generation, segments, json.loads(text)["written"])
        live = {p for s in store.generation(generation).sources.values() for p in s.paths}
        new = sorted(live - {f for s in segments for f in s.folders})
        added = [SegmentedIndex._index(store, generation, new)] if new else []
        segments = [*segments, *added]
        written = sum(s.postings for s in added)
        segments = [s for s in segments if live & s.folders.keys()]
        segments = SegmentedIndex._merged(store, segments, live)
        store._write(f"term-segments/{generation}.json", json.dumps({"segments": [vars(s) for s in segments], "written": written}))
        return SegmentedIndex(store, generation, segments, written)

    @staticmethod
    def _index(store: Snapshots, generation: str, folders: list[str]) -> Segment:
        """A segment of the events in ``folders``; only these are cut into tokens.

        Until the blocks are made an event is one row with its terms, so what is
        shuffled is compact; blocks are written by the task that makes them.
        """
        new = set(folders)
        events = store._parts([(k, p) for k, s in store.generation(generation).sources.items() for p in s.paths if p in new])
        held = events.select(F.col("path").alias("folder"), "event_id", tokens(F.coalesce(body_search(), F.lit(""))).alias("tokens"))
        held = held.withColumn("length", F.size("tokens")).withColumn("terms", term_counts(F.col("tokens")))
        path = store.work_path("terms")
        cut = held.select("folder", "event_id", "length", length_code(F.col("length")).alias("norm"), F.col("terms.term").alias("terms"), F.col("terms.tf").cast("array<int>").alias("tfs"))
        cut.withColumn("norm_class", F.floor(F.col("norm") / 4).cast("int")).withColumn("key", F.xxhash64("folder", "event_id")).write.parquet(path)  # cut once
        held = store.spark.read.parquet(path)
        facts = held.groupBy("folder").agg(F.count(F.lit(1)).alias("events"), F.sum("length").alias("length"), F.sum(F.size("terms")).alias("postings")).collect()  # one row a folder, as in the manifest
        seen = {r["folder"]: [r["events"], r["length"]] for r in facts}
        n, postings = sum(r["events"] for r in facts), sum(r["postings"] for r in facts)
        placed = held.select("key", "folder", "event_id", "norm", "terms", "tfs").join(SegmentedIndex._stripes(held, n), ["key", "folder", "event_id"])
        name = uuid.uuid4().hex
        near = placed.repartition(max(1, math.ceil(postings / POSTINGS_PER_TASK)), "stripe").sortWithinPartitions("stripe", "event_id")
        blocks = near.mapInArrow(_blocks, BLOCK.removesuffix(", bucket int"))
        SegmentedIndex._sorted_blocks(store, blocks.withColumn("bucket", _bucket(F.col("term"))), name)
        return Segment(name, postings, {f: seen.get(f, [0, 0]) for f in folders})

    @staticmethod
    def _stripes(held: DataFrame, n: int) -> DataFrame:
        """(key, folder, event_id, norm_class, stripe): events of like length that are about the same thing.

        An event leads with the term that is most frequent in it for how widespread
        it is, among the ``LEADS`` most widespread that make up a stripe at all. Many
        events with one lead are stripes of their own, others are put together by the
        hash of theirs. Terms are numbered and sent to all tasks, so that no posting
        is shuffled; strength and number are one whole number.
        """
        terms = held.select("key", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("key", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
        spread = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= STRIPE // 4).orderBy(F.desc("df"), "term").limit(LEADS)
        numbered = spread.withColumn("lead", F.row_number().over(Window.orderBy(F.desc("df"), "term")))  # LEADS rows at most
        strength = F.least(F.col("tf") * F.log(F.lit(1.0 + n) / F.col("df")) * 1000, F.lit(float(1 << 44))).cast("long")
        led = terms.join(F.broadcast(numbered), "term").groupBy("key").agg((F.max(strength * (2 * LEADS) + F.col("lead")) % (2 * LEADS)).alias("lead"))
        events = held.select("key", "folder", "event_id", "norm_class").join(led, "key", "left").withColumn("lead", F.coalesce("lead", F.lit(0)))
        leads = events.groupBy("folder", "norm_class", "lead").agg(F.count(F.lit(1)).alias("n"))
        rest = leads.filter(F.col("n") < STRIPE // 4).groupBy("folder", "norm_class").agg(F.sum("n").alias("rest"))
        sizes = leads.join(rest, ["folder", "norm_class"], "left")
        own = F.concat_ws(":", F.lit("own"), "lead", F.pmod(F.xxhash64("event_id"), F.ceil(F.col("n") / STRIPE)))
        shared = F.concat_ws(":", F.lit("shared"), F.pmod(F.xxhash64("lead"), F.ceil(F.col("rest") / STRIPE)))
        stripe = F.concat_ws(":", F.substring(F.md5("folder"), 1, 12), "norm_class", F.when(F.col("n") < STRIPE // 4, shared).otherwise(own))
        return events.join(sizes, ["folder", "norm_class", "lead"]).select("key", "folder", "event_id", "norm_class", stripe.alias("stripe"))

    @staticmethod
    def _sorted_blocks(store: Snapshots, blocks: DataFrame, name: str) -> None:
        blocks.sortWithinPartitions("bucket", "term", "norm_class", "stripe").write.partitionBy("bucket").parquet(f"{store.root}/term-segments/{name}")

    @staticmethod
    def _write_blocks(store: Snapshots, blocks: DataFrame, name: str, postings: int) -> None:
        share = max(1, math.ceil(postings / (BUCKETS * POSTINGS_PER_TASK)))  # a term that most events hold is no single task
        SegmentedIndex._sorted_blocks(store, blocks.repartition(BUCKETS * share, "bucket", F.pmod(F.xxhash64("stripe"), F.lit(share))), name)

    @staticmethod
    def _read_blocks(store: Snapshots, names: list[str]) -> DataFrame:
        if not names:
            return store.spark.createDataFrame([], BLOCK)
        return store.spark.read.schema(BLOCK).option("basePath", f"{store.root}/term-segments").parquet(*[f"{store.root}/term-segments/{n}" for n in names])

    @staticmethod
    def _size(store: Snapshots, name: str) -> int:
        return SegmentedIndex._read_blocks(store, [name]).agg(F.sum("n").alias("n")).first()["n"] or 0

    @staticmethod
    def _merged(store: Snapshots, segments: list[Segment], live: set[str]) -> list[Segment]:
        """Tier by tier, until none has as many as ``MERGE`` segments."""
        while True:
            by_tier: dict[int, list[Segment]] = {}
            for s in segments:
                by_tier.setdefault(s.tier, []).append(s)
            full = next((group for _, group in sorted(by_tier.items()) if len(group) >= MERGE), None)
            if full is None:
                return segments
            name = uuid.uuid4().hex
            parts = [SegmentedIndex._live_blocks(store, s, live) for s in full]
            blocks = parts[0]
            for p in parts[1:]:
                blocks = blocks.unionByName(p)
            SegmentedIndex._write_blocks(store, blocks, name, sum(s.postings for s in full))
            one = Segment(name, SegmentedIndex._size(store, name), {f: n for s in full for f, n in s.folders.items() if f in live})
            segments = [s for s in segments if s not in full] + [one]

    @staticmethod
    def _live_blocks(store: Snapshots, segment: Segment, live: set[str]) -> DataFrame:
        blocks = SegmentedIndex._read_blocks(store, [segment.name])
        dead = sorted(segment.folders.keys() - live)
        if not dead:
            return blocks
        gone = store.spark.createDataFrame([(f,) for f in dead], "folder string")
        return blocks.join(gone, "folder", "left_anti")

    # -- searching ---------------------------------------------------------
    def of_terms(self, terms: list[str]) -> DataFrame:
        """Live blocks of the terms; folders and row groups are chosen from the plan's literals."""
        buckets = self.spark.range(1).select(F.array(*[_bucket(F.lit(t)) for t in terms]).alias("b")).first()["b"]
        wanted = F.col("bucket").isin(*sorted(set(buckets))) & F.col("term").isin(*terms)
        parts = [self._live_blocks(self.store, s, self.live).filter(wanted) for s in self.segments]
        found = parts[0] if parts else self._read_blocks(self.store, [])
        for p in parts[1:]:
            found = found.unionByName(p)
        return found

    def document_frequencies(self, terms: list[str]) -> dict[str, int]:
        return {r["term"]: r["n"] for r in self.of_terms(terms).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most as many rows as terms

    def _impact(self, frequency: dict[str, int], tf: Column, norm: Column) -> Column:
        """What a posting adds to a score, by its ``term``."""
        mean = self.total_length / max(self.n_docs, 1)
        weight = F.lit(None).cast("double")
        for t, df in frequency.items():
            weight = F.when(F.col("term") == t, math.log(1.0 + (self.n_docs - df + 0.5) / (df + 0.5))).otherwise(weight)
        length = length_of_code(norm).cast("double")
        return weight * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * length / mean))

    def _scored(self, blocks: DataFrame, terms: list[str], frequency: dict[str, int], rows: DataFrame | None, scope: str | None) -> DataFrame:
        """(columns of ``rows``, coverage, score) of the events in ``blocks``; terms are added in their order."""
        one = blocks.select("term", F.explode(F.arrays_zip("event_ids", "tfs", "norms")).alias("p")).select("term", F.col("p.event_ids").alias("event_id"), F.col("p.tfs").alias("tf"), F.col("p.norms").alias("norm"))
        weighed = one.withColumn("impact", self._impact(frequency, F.col("tf").cast("double"), F.col("norm")))
        parts = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("impact"))), F.lit(0.0)) for t in terms]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        scored = weighed.groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("coverage"), total.alias("score"))
        if rows is not None:
            scored = rows.join(scored, "event_id")
        return scored if scope is None else scored.withColumn("score", F.col("score") * class_weight(F.col("event_type"), scope))

    def best(self, terms: list[str], k: int = POOL, rows: DataFrame | None = None, scope: str | None = None, tiers: bool = False) -> Found:
        """The k best events that hold a term: by score, or with ``tiers`` by
        coverage and then score; equals by id.

        ``rows``: only these may be found, their columns (event_id, and event_type if
        ``scope`` weighs classes) come along; statistics stay those of the corpus.
        Class weights are 1 at most, so the bounds hold for them too.
        """
        terms = sorted(set(terms))
        frequency = self.document_frequencies(terms) if terms else {}
        terms = [t for t in terms if t in frequency]
        base = self.spark.createDataFrame([], "event_id string") if rows is None else rows.limit(0)
        nothing = self.spark.createDataFrame([], T.StructType([*base.schema.fields, T.StructField("coverage", T.IntegerType()), T.StructField("score", T.DoubleType())]))
        if not terms:
            return Found(nothing, 0, 0)
        key = ["folder", "stripe"]
        blocks = self.of_terms(terms)
        tier = 1e6 if tiers else 0.0  # above every score
        bound = F.sum(self._impact(frequency, F.col("max_tf").cast("double"), F.col("min_norm")) + tier)
        bounds = blocks.groupBy(*key, "norm_class").agg(bound.alias("bound"), F.max("n").alias("events"), F.count(F.lit(1)).alias("blocks"))
        path = self.store.work_path("bounds")
        bounds.write.parquet(path)
        bounds = self.spark.read.schema(bounds.schema).parquet(path)
        value = F.col("coverage") * tier + F.col("score")
        order = [F.round("score", 9).desc(), F.col("event_id").asc()]
        order = [F.col("coverage").desc(), *order] if tiers else order

        scored = lambda stripes, longest: self._scored(self._of_stripes(blocks, stripes, longest), terms, frequency, rows, scope)
        promising = bounds.orderBy(F.desc("bound"), *key).limit(max(k, sum(ROUNDS))).collect()  # that many at most
        pool, least, at, read = nothing, -1.0, 0, 0
        for n, most in enumerate(ROUNDS):
            some, held = [], 0
            for r in promising[at:]:
                if r["bound"] < least or (len(some) >= most and (n or held >= k)):
                    break
                some.append(r)
                held += r["events"]
            if not some:
                break
            at, read = at + len(some), read + sum(r["blocks"] for r in some)
            chosen = self.spark.createDataFrame([(r["folder"], r["stripe"]) for r in some], "folder string, stripe string")
            path = self.store.work_path("pool")
            pool.unionByName(scored(chosen, max(r["norm_class"] for r in some))).orderBy(*order).limit(k).write.parquet(path)
            pool = self.spark.read.schema(pool.schema).parquet(path)
            last = pool.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("v")).first()
            least = last["v"] - SLACK if last["n"] >= k else -1.0
        # What is left: stripes whose bound reaches the pool's last score.
        done = self.spark.createDataFrame([(r["folder"], r["stripe"]) for r in promising[:at]], "folder string, stripe string")
        rest = bounds.filter(F.col("bound") >= least).join(F.broadcast(done), key, "left_anti")
        seen = rest.agg(F.sum("blocks").alias("n"), F.max("norm_class").alias("c")).first()
        total = bounds.agg(F.sum("blocks").alias("n")).first()["n"]
        if seen["n"]:
            read += seen["n"]
            pool = pool.unionByName(scored(rest.select(*key), seen["c"]))
        return Found(pool.orderBy(*order).limit(k), total, read)

    @staticmethod
    def _of_stripes(blocks: DataFrame, chosen: DataFrame, longest: int) -> DataFrame:
        """Blocks of the stripes; ``longest`` is a literal, so longer classes are skipped by the scan."""
        return blocks.filter(F.col("norm_class") <= longest).join(chosen, ["folder", "stripe"], "left_semi")
