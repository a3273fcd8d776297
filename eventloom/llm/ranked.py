"""Ranked lexical search by trees of maxima over ranges of documents.

Terms are maximal runs of letters, digits and characters beyond ASCII, with only
A-Z lower-cased. With N the documents that hold a term, L all their terms with
repeats, n those of one document, df the documents holding a term and tf its
occurrences in one, all but the logarithm in 64-bit integers:

    weight = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))
    m      = 100 - 25 + (25 * n * N) div L
    impact = (1000000000 * tf) div (1000 * tf + 12 * m)
    score  = sum of weight * impact over the query's terms, repeats included

1. *Index.* Each task packs its documents in shards of at most ``SHARD_DOCS``
   documents and about ``SHARD_POSTINGS`` postings: a map without a shuffle. For a
   stated set of queries whose distinct terms fit in ``VOCABULARY_BYTES`` only
   their terms get postings; N, L and df always count everything.
2. *Tree.* In a shard, documents with the same most widespread term lie side by
   side, the strongest first. Ranges of ``LEAF`` documents, of ``FAN`` such ranges
   and so on up to the whole shard hold for each term its greatest impact in the
   range. A node's entries lie together, so the bounds of a node's children are
   one product and sum.
3. *Search.* Best first: the node with the highest summed bound is opened next;
   its children, or its documents' exact scores, take its place. A query is
   done in a shard when the highest bound is below its k-th best score; nodes
   whose bound equals it are opened, unless all of their ids come after the k-th's.
   The best so far go on from shard to shard of a task, so later shards open little.
4. Each task returns at most k documents a query; the best of all tasks are ranked.

Queries are sent to the tasks in blocks of at most ``BLOCK_BYTES``, one block after
the other, each against all documents.

Defined results: null and empty texts hold no term and count nowhere; rows of
documents without an id count in N, L and df but aren't returned; rows of one
query id make up one query; repeated document rows are documents of their own,
returned each; a query without a known term, or an empty table, gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import quoted, scratch_path, small_batches, staged

TOP = 20
SHARD_DOCS = 8192
SHARD_POSTINGS = 500_000
LEAF = 8
FAN = 8
VOCABULARY_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
ROW_GROUP_BYTES = 32 << 20

#: One pass over UTF-8 bytes: what separates terms becomes a space, A-Z becomes a-z.
_SEPARATED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes(range(256)).lower())


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_SEPARATED).split() if text else []


class _Packer:
    """Documents of one task, packed in shard rows."""

    def __init__(self, vocabulary: frozenset[bytes] | None, id_type: pa.DataType) -> None:
        self.vocabulary, self.id_type = vocabulary, id_type
        self.clear()

    def clear(self) -> None:
        self.n_docs = self.n_terms = 0
        self.number: dict[bytes, int] = {}
        self.df: list[int] = []
        self.ids: list = []
        self.sizes: list[int] = []
        self.starts: list[int] = [0]
        self.post_term: list[int] = []
        self.post_tf: list[int] = []

    def add(self, doc_id: object, text: bytes | None) -> None:
        found = terms_of(text)
        if not found:
            return
        self.n_docs += 1
        self.n_terms += len(found)
        counts = Counter(found)
        kept = counts if self.vocabulary is None else [t for t in counts if t in self.vocabulary]
        for t in kept:
            i = self.number.setdefault(t, len(self.df))
            if i == len(self.df):
                self.df.append(0)
            self.df[i] += 1
            if doc_id is not None:
                self.post_term.append(i)
                self.post_tf.append(counts[t])
        if doc_id is not None and len(self.post_term) > self.starts[-1]:
            self.ids.append(doc_id)
            self.sizes.append(len(found))
            self.starts.append(len(self.post_term))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.post_term) >= SHARD_POSTINGS or self.n_docs >= 8 * SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        packed = [np.array(x, t).tobytes() for x, t in ((self.sizes, np.int64), (self.starts, np.int64), (self.post_term, np.int32), (self.post_tf, np.int32))]
        made = pa.RecordBatch.from_arrays(
            [
                pa.array([self.n_docs], pa.int64()),
                pa.array([self.n_terms], pa.int64()),
                pa.array([[t.decode("utf-8", "replace") for t in self.number]], pa.list_(pa.string())),
                pa.array([self.df], pa.list_(pa.int32())),
                pa.array([self.ids], pa.list_(self.id_type)),
                *[pa.array([p], pa.binary()) for p in packed],
            ],
            _INDEX_COLUMNS,
        )
        self.clear()
        return made


_INDEX_COLUMNS = ["n_docs", "n_terms", "terms", "df", "ids", "sizes", "starts", "post_term", "post_tf"]


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: frozenset[bytes] | None = None, path: str | None = None) -> DataFrame:
    """The shard rows of all documents, written to ``path`` (default: a scratch table) and read back.

    ``vocabulary``: the terms that get postings, in UTF-8; None for all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_column].dataType
    sent = spark.sparkContext.broadcast(vocabulary)
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(sent.value, arrow_id)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, text)
                if packer.full():
                    yield packer.row()
        if packer.n_docs:
            yield packer.row()

    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType()), T.ArrayType(id_type), *[T.BinaryType()] * 4]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(_INDEX_COLUMNS, kinds, strict=True)])
    rows = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text_column)).cast("string").cast("binary").alias("text")).mapInArrow(run, schema)
    path = path or scratch_path(spark, "ranked")
    rows.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _grouped(term: np.ndarray, value: np.ndarray, starts: np.ndarray, width: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, maxima, starts) of the ranges of ``width`` nodes, by range, then term."""
    nodes = len(starts) - 1
    node = np.repeat(np.arange(nodes) // width, np.diff(starts))
    key = node * n_terms + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    parents = -(-nodes // width)
    return key[first] % n_terms, np.maximum.reduceat(value[order], first), np.searchsorted(key[first] // n_terms, np.arange(parents + 1))


class ShardTree:
    """A shard's documents and the maxima of their ranges, level by level from the documents up."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, weights: dict[str, int]) -> None:
        sizes, starts = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["starts"], np.int64)
        term, tf = np.frombuffer(row["post_term"], np.int32).astype(np.int64), np.frombuffer(row["post_tf"], np.int32).astype(np.int64)
        m = 75 + (25 * sizes * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(starts)))
        self.number = {t: i for i, t in enumerate(row["terms"])}
        weight = np.array([weights.get(t, 0) for t in row["terms"]], np.int64)
        asked = np.concatenate([[0], np.cumsum(weight[term] > 0)])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        docs = np.flatnonzero(np.diff(asked[starts]) > 0)  # with a term that counts
        if not len(docs):
            return
        live = (weight[term] > 0) & np.isin(np.repeat(np.arange(len(sizes)), np.diff(starts)), docs)
        term, impact = term[live], impact[live]
        starts = np.concatenate([[0], np.diff(asked[starts])[docs].cumsum()])
        df = np.array(row["df"], np.int64)
        widest = np.maximum.reduceat(df[term] * len(df) + term, starts[:-1])
        strength = np.add.reduceat(weight[term] * impact, starts[:-1])
        order = np.lexsort((-strength, widest))
        ids = row["ids"]
        self.ids = [ids[docs[i]] for i in order]
        by_id = np.empty(len(order), np.int64)
        by_id[sorted(range(len(order)), key=self.ids.__getitem__)] = np.arange(len(order))
        lengths = np.diff(starts)[order]
        places = np.repeat(starts[:-1][order] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        self.levels.append((term[places], impact[places], np.concatenate([[0], np.cumsum(lengths)])))
        self.widths = [0]
        self.least = [by_id]  # least rank by id in each node: equal bounds are worth opening only for smaller ids
        while len(self.levels[-1][2]) - 1 > 1:
            width = LEAF if len(self.levels) == 1 else FAN
            self.levels.append(_grouped(*self.levels[-1], width, len(df)))
            self.widths.append(width)
            self.least.append(np.minimum.reduceat(self.least[-1], np.arange(0, len(self.least[-1]), width)))
        self.sorted_ids = sorted(self.ids)

    def search(self, query: list[tuple[str, int]], best: list[tuple[int, object]], k: int = TOP) -> int:
        """Put the query's documents among ``best``: (-score, id), at most k, in order.

        Returns how many documents were scored.
        """
        if not self.levels:
            return 0
        asked = np.zeros(len(self.number), np.int64)
        for t, w in query:
            if t in self.number:
                asked[self.number[t]] += w
        scored, top = 0, len(self.levels) - 1
        root = int(self._sums(asked, top, 0, 1)[0])
        heap = [(-root, top, 0)] if root > 0 else []
        while heap:
            bound, level, node = heapq.heappop(heap)
            if not self._worth(-bound, level, node, best, k):
                if -bound < -best[-1][0]:
                    break  # no other node has a higher bound
                continue  # equal bound, but later ids
            if level == 0:
                insort(best, (bound, self.ids[node]))
                del best[k:]
                continue
            low = node * self.widths[level]
            high = min(low + self.widths[level], len(self.levels[level - 1][2]) - 1)
            sums = self._sums(asked, level - 1, low, high)
            scored += (high - low) * (level == 1)
            least = -best[-1][0] if len(best) == k else 1
            for i in np.flatnonzero(sums >= least):
                heapq.heappush(heap, (-int(sums[i]), level - 1, low + int(i)))
        return scored

    def _sums(self, asked: np.ndarray, level: int, low: int, high: int) -> np.ndarray:
        term, value, starts = self.levels[level]
        a, b = starts[low], starts[high]
        return np.add.reduceat(asked[term[a:b]] * value[a:b], starts[low:high] - a)

    def _worth(self, bound: int, level: int, node: int, best: list[tuple[int, object]], k: int) -> bool:
        if len(best) < k or bound > -best[-1][0]:
            return True
        return bound == -best[-1][0] and self.sorted_ids[self.least[level][node]] < best[-1][1]


def _query_terms(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, term, times): rows of one id together."""
    id_type = queries.schema[id_column].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, c) for i, text in enumerate(batch.column(1).to_pylist()) for t, c in Counter(terms_of(text)).items()]
            items = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())).cast(arrow_id)
            yield pa.RecordBatch.from_arrays([items, pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["item", "term", "times"])

    schema = T.StructType([T.StructField("item", id_type), T.StructField("term", T.StringType()), T.StructField("times", T.LongType())])
    cut = queries.select(F.col(quoted(id_column)).alias("item"), F.col(quoted(text_column)).cast("string").cast("binary").alias("text")).mapInArrow(run, schema)
    return cut.groupBy("item", "term").agg(F.sum("times").alias("times"))


def search_block(index: DataFrame, weights: dict[str, int], queries: list[tuple[object, list[tuple[str, int]]]], statistics: tuple[int, int], item_type: T.DataType, k: int) -> DataFrame:
    """(item, id, score) of at most k documents a query and task, the best of all among them."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((weights, queries))
    id_type = index.schema["ids"].dataType.elementType
    arrow_item, arrow_id = to_arrow_type(item_type), to_arrow_type(id_type)
    columns = ["df", "terms", "ids", "sizes", "starts", "post_term", "post_tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = sent.value
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                tree = ShardTree({c: batch.column(i)[r].as_py() for i, c in enumerate(columns)}, *statistics, weights)
                for (_, query), so_far in zip(queries, best, strict=True):
                    tree.search(query, so_far, k)
        rows = [(item, doc_id, -score) for (item, _), so_far in zip(queries, best, strict=True) for score, doc_id in so_far]
        if rows:
            items, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(items, arrow_item), pa.array(ids, arrow_id), pa.array(scores, pa.int64())], ["item", "id", "score"])

    schema = T.StructType([T.StructField("item", item_type), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    return index.select(*columns).mapInArrow(run, schema)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The k best documents of each query: the query's id, ``rank`` (from 1), the
    document's id and ``score``; equal scores by ascending document id.

    If both id columns have one name, the query's is called ``item``.
    """
    asked = staged(_query_terms(queries, item_column, item_text_column), "asked")
    vocabulary = asked.select("term").distinct()
    size = vocabulary.agg(F.sum(F.octet_length("term") + 8).alias("b")).first()["b"] or 0
    known = frozenset(r["term"].encode() for r in vocabulary.collect()) if size <= VOCABULARY_BYTES else None
    index = build_index(docs, id_column, text_column, known)
    return _searched(index, asked, queries.schema[item_column].dataType, k, id_column, item_column)


def _searched(index: DataFrame, asked: DataFrame, item_type: T.DataType, k: int, id_column: str, item_column: str) -> DataFrame:
    spark = index.sparkSession
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 0
    frequency = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = staged(asked.join(frequency, "term").select("item", "term", "times", weight.alias("weight")).filter("weight > 0"), "weighed")
    bytes_of = weighed.agg(F.sum(F.octet_length("term") + 16).alias("b")).first()["b"] or 0
    blocks = math.ceil(bytes_of / BLOCK_BYTES)
    found = []
    for b in range(blocks):
        some = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = some.groupBy("item").agg(F.collect_list(F.struct("term", "times", "weight")).alias("terms")).collect()  # at most BLOCK_BYTES of terms
        weights = {t["term"]: t["weight"] for r in rows for t in r["terms"]}
        block = [(r["item"], [(t["term"], t["times"] * t["weight"]) for t in r["terms"]]) for r in rows]
        found.append(search_block(index, weights, block, (n, length), item_type, k))
        if blocks > 1:
            found[-1] = staged(found[-1], "found")
    id_type = index.schema["ids"].dataType.elementType
    if not found:
        found.append(spark.createDataFrame([], T.StructType([T.StructField("item", item_type), T.StructField("id", id_type), T.StructField("score", T.LongType())])))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id"))).alias("rank")
    item_name = "item" if item_column.lower() == id_column.lower() else item_column
    return every.select("item", place, "id", "score").filter(F.col("rank") <= k).toDF(item_name, "rank", id_column, "score")
