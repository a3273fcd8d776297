"""Best-fit packing by a linear grouping scheme.

Documents are tokenised, given an end token, cut at the capacity where longer,
and packed into as few sequences as can be found:

1. Lengths are counted: at most ``capacity`` numbers, whatever the corpus. All
   planning works on these, on the driver, in counts and never in documents.
2. Large lengths (an eighth of the capacity and up) are ranked, cut into
   ``N_GROUPS`` groups of equal cardinality and rounded up to the largest of
   their group.
3. Configurations of these few sizes are optimised together: a linear program
   over all configurations, whose columns are generated by a knapsack over the
   dual prices, until it is within a thousandth of the optimum. Whole parts are
   taken; the rest is less than one sequence a size.
4. The actual documents are put in by rank, but for the smallest of each
   configuration; how many of these are held back is tried (``HELD``), down to all
   of them, and the plan with the fewest sequences is taken. As ranks of a length are contiguous, the room left in each
   sequence follows from the counts alone.
5. Those held back, the rest and the small lengths go, longest first, to the
   fullest sequences with room for them (best fit), again in counts; what finds no
   room opens new sequences. So room that rounding up left is used.

The plan is a list of rules (first rank, period, first sequence); a document's
rank among all lengths, found with window functions over small buckets, gives
its sequence. Pieces of full length are sequences by themselves and take no part.

Defined results: null and empty texts are the end token alone; repeated rows
are packed each; a text of any length is cut into whole pieces; an empty table
gives an empty result; other columns pass through if named in ``keep``.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, map_texts, packed, quoted, small_batches, staged

CAPACITY = 2048
END_ID = 0
N_GROUPS = 48
HELD = (1, 0, 2, 3, 7, None)
TOLERANCE = 1e-3  # of the linear program
MOST_PIVOTS = 4000  # far above the need; any basis gives a valid plan
SMALL_SHARE = 8  # lengths under capacity / 8 are small
BUCKET_ROWS = 1 << 16  # pieces of a length ranked by one task
MOST_BUCKETS = 4096
CACHED_WORDS = 600_000
CACHED_CHARS = 8_000_000
WORD = re.compile("[^ \t\n\r]+")
FINE_WORD = re.compile(r"[^\W\d_]+|(?:[\d_]|[^\w \t\n\r])+")


class WordIds:
    """Ids of texts by way of a bounded cache of the ids of their words.

    For tokenizers that drop white space and never merge across it. Words are
    cut at four plain space characters, and between letters and other
    characters where a text is in composed form and has neither apostrophes
    nor strings of special tokens, which a cut could part. Words of letters go
    straight to the tokenizer's merges, if probes show that this gives the same
    ids; all others go through the tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        probes = ["a", "The", "ENTEN", "antidisestablishment", "\u00e9quech", "stra\u00dfe", "\u0416\u0443\u043a", "\u6f22\u5b57", "\ud55c\uad6d"]
        self.direct = all(self._merged(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probes)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = self.filled = 0
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 12, np.int64)
        self.counts = np.empty(1 << 12, np.int64)

    def _merged(self, word: str) -> list[int]:
        low = word.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.byte_letters)
        return [t.id for t in self.tokenizer.model.tokenize(low)]

    def _learn(self, words: list[str]) -> None:
        found: list[list[int] | None] = [None] * len(words)
        if self.direct:
            for i, w in enumerate(words):
                # Capital sigma is lowered by its place, dotted capital I to two characters.
                if w.isalpha() and (w.isascii() or ("\u03a3" not in w and "\u0130" not in w and unicodedata.is_normalized("NFC", w))):
                    found[i] = self._merged(w)
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum()))
        first, end = len(self.number), len(self.number) + len(words)
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while end > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.counts))
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.counts[first:end] = counts
        self.starts[first:end] = self.filled + np.cumsum(counts) - counts
        self.number.update(zip(words, range(first, end), strict=True))
        self.filled += len(flat)
        self.chars += sum(map(len, words))

    def _words(self, text: str) -> list[str]:
        safe = text.isascii() or (unicodedata.is_normalized("NFC", text) and "\u0130" not in text)
        if safe and "'" not in text and not any(s in text for s in self.special):
            return FINE_WORD.findall(text)
        return WORD.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.clear()
        words = [self._words(t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        new = list(dict.fromkeys(itertools.filterfalse(self.number.__contains__, flat)))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[at] - (ends - counts), counts)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)].astype(np.int64)
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def tokenised_pieces(docs: DataFrame, tokenizer_file: str, text_column: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(kept columns, piece, start, length, ids_crc32) of every piece of every text."""
    kept = kept_columns(docs, keep, ["piece", "start", "length", "ids_crc32"])

    def make():
        words = WordIds(tokenizer_file)

        def cut(texts: list) -> tuple:
            source, rows = [], []
            for first in range(0, len(texts), 200):
                for i, body in enumerate(words.encode(texts[first : first + 200])):
                    ids = np.append(body, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        source.append(first + i)
                        rows.append((piece, start, len(part), zlib.crc32(part.tobytes())))
            return source, list(zip(*rows, strict=True)) if rows else [[]] * 4

        return cut

    return map_texts(docs, kept, text_column, {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}, make)


def _best_configuration(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The counts by size that fit ``capacity`` and have the highest total price."""
    best, taken = np.zeros(capacity + 1), []
    for size, price in zip(sizes, prices, strict=True):
        upto, n_here = best.copy(), np.zeros(capacity + 1, np.int64)
        for n in range(1, capacity // size + 1) if price > 0 else ():
            value = best[: -n * size] + n * price
            better = value > upto[n * size :]
            upto[n * size :][better], n_here[n * size :][better] = value[better], n
        best = upto
        taken.append(n_here)
    used, room = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        used[i] = taken[i][room]
        room -= used[i] * sizes[i]
    return used, float(best[capacity])


def optimised_configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts by size index, times) that together use no size more often than it occurs.

    Simplex with column generation: begins with one size a configuration and
    exchanges a configuration as long as the prices of the sizes admit a better
    one. The optimum's times are rounded down.
    """
    if not sizes:
        return []
    demand = np.array(counts, float)
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    times = inverse @ demand
    for pivot in range(MOST_PIVOTS):
        entering, value = _best_configuration(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + TOLERANCE:  # the optimum is at least the present one divided by value
            break
        change = inverse @ entering
        ratio = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1.0), np.inf)
        leaving = int(ratio.argmin())
        columns[:, leaving] = entering
        row = inverse[leaving] / change[leaving]
        inverse -= np.outer(change, row)
        inverse[leaving] = row
        if pivot % 64 == 63:
            inverse = np.linalg.inv(columns)  # sheds rounding errors
        times = np.maximum(inverse @ demand, 0)
    left, found = np.array(counts, np.int64), []
    for column, n in zip(columns.T.astype(np.int64), np.floor(times + 1e-6).astype(np.int64), strict=True):
        n = min(int(n), *(int(left[i] // column[i]) for i in np.flatnonzero(column)))
        if n > 0:
            left -= n * column
            found.append(({int(i): int(column[i]) for i in np.flatnonzero(column)}, n))
    return found


def plan_packing(counts: list[int], capacity: int = CAPACITY, n_groups: int = N_GROUPS) -> tuple[list[tuple[int, int, int]], int]:
    """The plan with the fewest sequences among those that hold back more or fewer
    lengths of each configuration for best fit; with all held back it is plain
    best-fit decreasing, so no plan is worse than that.
    """
    found: dict = {}
    return min((_planned(counts, capacity, n_groups, held, found) for held in HELD), key=lambda plan: plan[1])


def _planned(counts: list[int], capacity: int, n_groups: int, held: int | None, found: dict) -> tuple[list[tuple[int, int, int]], int]:
    """Rules (first rank, period, first sequence) and the number of sequences.

    ``held``: how many lengths of a configuration, the smallest, are put in by best
    fit, if it has more; None for all. ``found`` keeps the configurations from plan
    to plan. ``counts[n]``: pieces of length n. Ranks run from the longest piece to the
    shortest; the piece of rank r under the rule with the largest first rank not
    above r goes to sequence first + (r - first rank) modulo period.
    """
    longest_first = [n for n in range(capacity, 0, -1) if counts[n]]
    rank_of, total = {}, 0
    for n in longest_first:
        rank_of[n] = total
        total += counts[n]
    rules, n_sequences = [], counts[capacity]
    if counts[capacity]:
        rules.append((0, counts[capacity], 0))
    edge = max(2, capacity // SMALL_SHARE)
    large = [n for n in longest_first if edge <= n < capacity]
    bounds = [rank_of[n] for n in large]  # where each length's ranks begin

    def length_at(rank: int) -> tuple[int, int]:
        """Length of a large rank, and the rank where that length ends."""
        i = bisect_left(bounds, rank + 1) - 1
        return large[i], bounds[i] + counts[large[i]]

    # Groups of equal cardinality, rounded up to their largest length.
    begin, end = counts[capacity], counts[capacity] + sum(counts[n] for n in large)

    sizes, left, cursor = [], [], []
    for a, b in itertools.pairwise(begin + (end - begin) * k // n_groups for k in range(n_groups + 1)):
        if a == b:
            continue
        size = length_at(a)[0]
        if sizes and sizes[-1] == size:
            left[-1] += b - a
        else:
            sizes.append(size), left.append(b - a), cursor.append(a)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, end)

    def place(used: dict[int, int], times: int) -> None:
        """``times`` new sequences of one configuration, from the next ranks of its groups."""
        nonlocal n_sequences
        slots = []
        for i, n in sorted(used.items()):
            rules.append((cursor[i], times, n_sequences))
            slots += [cursor[i] + j * times for j in range(n)]
            cursor[i] += n * times
            left[i] -= n * times
        # Lengths go down along each slot's run of ranks: cut where one ends.
        at = 0
        while at < times:
            here = [length_at(s + at) for s in slots]
            upto = min([times, *[e - s for (_, e), s in zip(here, slots, strict=True)]])
            gaps.setdefault(capacity - sum(n for n, _ in here), []).append((n_sequences + at, n_sequences + upto))
            at = upto
        n_sequences += times

    if held is not None and "configurations" not in found:
        found["configurations"] = optimised_configurations(sizes, left, capacity)
    for whole, times in found["configurations"] if held is not None else []:
        used = dict(whole)
        for _ in range(min(held, sum(used.values()) - 1)):
            used[max(i for i, n in used.items() if n)] -= 1  # closed below by the actual length that fits best
        place({i: n for i, n in used.items() if n}, times)
    # Best fit, longest first and by counts: what closes configurations, what
    # rounding down left over, and the small ones.
    open_gaps = sorted(g for g in gaps if g > 0)
    waiting = []
    for rank, n_left in zip(cursor, left, strict=True):
        while n_left:
            n, upto = length_at(rank)
            waiting.append((n, rank, min(n_left, upto - rank)))
            rank, n_left = rank + waiting[-1][2], n_left - waiting[-1][2]
    waiting += [(n, rank_of[n], counts[n]) for n in longest_first if n < min(edge, capacity)]
    for n, rank, rest in waiting:
        while rest:
            k = bisect_left(open_gaps, n)
            if k == len(open_gaps):
                each = capacity // n
                new = rest // each  # sequences full of this length, then one begun
                if not new:
                    gaps.setdefault(capacity, []).append((n_sequences, n_sequences + 1))
                    n_sequences += 1
                    insort(open_gaps, capacity)
                    continue
                for _ in range(each):
                    rules.append((rank, new, n_sequences))
                    rank += new
                room = capacity - each * n
                if room > 0:
                    if room not in gaps:
                        insort(open_gaps, room)
                    gaps.setdefault(room, []).append((n_sequences, n_sequences + new))
                rest -= new * each
                n_sequences += new
                continue
            gap = open_gaps[k]
            a, b = gaps[gap].pop()
            take = min(rest, b - a)
            if take < b - a:
                gaps[gap].append((a + take, b))
            if not gaps[gap]:
                del gaps[gap], open_gaps[k]
            rules.append((rank, take, a))
            rank, rest, room = rank + take, rest - take, gap - n
            if room > 0:
                if room not in gaps:
                    insort(open_gaps, room)
                gaps.setdefault(room, []).append((a, a + take))
    return sorted(rules), n_sequences


def _assign(rules: list[tuple[int, int, int]], starts: np.ndarray, base: np.ndarray):
    """Ranks and sequences of pieces.

    ``base``: first rank of each bucket, those of a length from ``starts`` on.
    """
    first, period, sequence = (np.array(x, np.int64) for x in zip(*rules, strict=True)) if rules else (np.empty(0, np.int64),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, bucket, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            rank = base[starts[length] + bucket] + place
            at = np.searchsorted(first, rank, side="right") - 1
            found = sequence[at] + (rank - first[at]) % period[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), pa.array(rank), pa.array(found)], ["piece_row", "length", "rank", "sequence_id"])

    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, text_column: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: kept columns, piece, start, length, ids_crc32, sequence_id, offset."""
    own = ["piece", "start", "length", "ids_crc32"]
    kept = kept_columns(docs, keep, [*own, "sequence_id", "offset"])
    small_batches(docs.sparkSession)
    pieces = staged(tokenised_pieces(docs, tokenizer_file, text_column, kept, capacity, end_id), "pieces")
    packing = pieces.select(packed([*kept, *own]).alias("piece_row"), F.col("length"), F.xxhash64(*[F.col(quoted(c)) for c in [*kept, *own]]).alias("hash"))
    # Full pieces have sequences of their own; a length may hold a third of all
    # others: it is ranked bucket by bucket, in the more buckets the more there are.
    lengths = {r["length"]: r["n"] for r in packing.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    counts = [lengths.get(n, 0) for n in range(capacity + 1)]
    buckets = [max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS))) for n in counts]
    n_buckets = F.element_at(F.array(*map(F.lit, buckets)), (F.col("length") + 1).cast("int"))
    full, others = packing.filter(F.col("length") == capacity), packing.filter(F.col("length") < capacity)
    bucketed = others.withColumn("bucket", F.pmod(F.col("hash"), n_buckets).cast("int"))
    sums = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    cells = {(r["length"], r["bucket"]): r["n"] for r in sums.collect()}  # one for BUCKET_ROWS pieces, and one a length
    # Planned without the full ones: their sequences are their row numbers, below 0.
    rules, _ = plan_packing([*counts[:capacity], 0], capacity)
    starts = np.cumsum([0, *buckets[:-1]])
    base, rank = np.zeros(sum(buckets), np.int64), 0
    for length, bucket in sorted(cells, key=lambda c: (-c[0], c[1])):
        base[starts[length] + bucket] = rank
        rank += cells[length, bucket]
    in_bucket = Window.partitionBy("length", "bucket").orderBy("hash", "piece_row")
    placed = bucketed.select("piece_row", F.col("length").cast("long"), "bucket", (F.row_number().over(in_bucket) - 1).cast("long").alias("place"))
    fields = [placed.schema["piece_row"], *[T.StructField(n, T.LongType()) for n in ("length", "rank", "sequence_id")]]
    shared = placed.mapInArrow(_assign(rules, starts, base), T.StructType(fields))
    before = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.select("piece_row", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    alone = full.select("piece_row", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = shared.unionByName(alone)
    return rows.select(*[F.col(f"piece_row.{quoted(c)}").alias(c) for c in [*kept, *own]], "sequence_id", "offset")
