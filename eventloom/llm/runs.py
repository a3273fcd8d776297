"""Periodic runs of words: stretches that repeat with a smallest period.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are identical), at least ``max(min_length, 3 * q)`` long, that no
neighbouring word extends with period q.

1. *Masking.* In a run [s, e) the words [s, e - q) come again at [s + q, e), and
   that overlap has at least ``min_overlap`` words: two thirds of the shortest
   run. Both stretches together hold every word of the run, so every word of a
   run lies in some k-gram of k = ``min_overlap`` words that the document holds
   twice. Words outside of all such k-grams can't join runs; what is left falls
   into segments, and a run lies in one segment wholly, neighbours that would
   extend it included. The k-grams are compared by 64-bit hashes: equal hashes of
   different k-grams only let more words through.
2. *Main-Lorentz* over the segments of many documents at once. A segment is
   halved again and again; a run that crosses a middle c has q words on one side
   of it, so comparing the words from c with those from c + q (or c - q), forwards
   and backwards, finds its ends. All middles and periods of one depth are one
   array operation. The comparisons read exact ranks of stretches of 1, 2, 4, ...
   words (equal stretches, equal rank), so a result rests on no hash.
3. Of one stretch found with several periods the smallest is kept: the others
   are its multiples, as a run is three periods long.

Every document is the work of one task, in memory in proportion to its words;
nothing is shuffled.

Defined results: null and empty texts have no words and no runs; the collapsed
text is never null; repeated rows are treated alike; an empty table gives an
empty result; other columns pass through unless they carry an added name.
"""

from __future__ import annotations

import re
from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, kept_columns, map_texts, quoted, small_batches

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Words that are searched together; one longer document is searched alone.
CHUNK_WORDS = 1 << 19
#: Ranks of stretches longer than 2 ** MAX_LEVEL words aren't kept: comparisons go on in steps of that length.
MAX_LEVEL = 16
ADDED = {"n_words": "long", "run_starts": "array<long>", "run_lengths": "array<long>", "run_periods": "array<long>", "collapsed": "string", "n_dropped": "long", "n_searched": "long"}


def min_overlap(min_length: int = MIN_LENGTH) -> int:
    """The least length - period of a run: at length ``min_length`` and a third of it as period."""
    return min_length - min_length // MIN_PERIODS


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def surviving(ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches in which every word is in a k-gram that its document holds twice.

    ``bounds``: where the documents begin in ``ids``, and the end of the last.
    """
    n = len(ids)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if n < k + 1:
        return none
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # hash of the k words from each place: Horner's rule by the bits of k
    base, value, length, power = np.uint64(0xD6E8FEB86659FD93), np.zeros(n, np.uint64), 0, np.uint64(1)
    block, width, block_power, rest = _mixed(ids), 1, base, k
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                shifted = np.zeros(n, np.uint64)
                shifted[: n - length] = block[length:]
                value, length, power = value + power * shifted, length + width, power * block_power
            rest >>= 1
            if rest:
                doubled = block.copy()
                doubled[: n - width] += block_power * block[width:]
                block, width, block_power = doubled, 2 * width, block_power * block_power
        value = _mixed(value + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    places = np.flatnonzero(np.arange(n) + k <= bounds[1:][doc])
    value = value[places]
    order = np.sort(value)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return none
    at = np.searchsorted(twice, value)
    places = places[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == value)]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + k, -1)
    covered = np.cumsum(change[:-1]) > 0
    first = np.zeros(n, bool)
    first[bounds[:-1][sizes > 0]] = True
    starts = np.flatnonzero(covered & (first | ~np.concatenate([[False], covered[:-1]])))
    last = np.concatenate([first[1:], [True]])
    ends = np.flatnonzero(covered & (last | ~np.concatenate([covered[1:], [False]]))) + 1
    return starts, ends


class _Stretches:
    """Exact ranks of all stretches of 1, 2, 4, ... words of a text."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        _, rank = np.unique(words, return_inverse=True)
        self.ranks = [rank.astype(np.int32)]
        for level in range(min(MAX_LEVEL, max(longest, 1).bit_length() - 1)):
            now, step = self.ranks[-1].astype(np.int64), 1 << level
            if len(now) <= step:
                break
            values, rank = np.unique(now[:-step] * (int(now.max()) + 1) + now[step:], return_inverse=True)
            if len(values) == len(rank):
                break  # no longer stretch is there twice
            self.ranks.append(rank.astype(np.int32))

    def common(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``i`` on and from ``j`` on agree (``back``: before them)."""
        count = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[level], 1 << level
            rows = np.arange(len(i))
            while len(rows):
                a = i[rows] - count[rows] - step if back else i[rows] + count[rows]
                b = j[rows] - count[rows] - step if back else j[rows] + count[rows]
                fits = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(rank))
                rows, a, b = rows[fits], a[fits], b[fits]
                rows = rows[rank[a] == rank[b]]
                count[rows] += step
                if level < len(self.ranks) - 1:
                    break  # a lower level fits once
        return count


def main_lorentz(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of the runs in the segments, by start and period."""
    long = ends - starts >= min_length
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    # The segments side by side, a word of its own before, between and after them.
    sizes = ends - starts
    begins = np.cumsum(sizes + 1) - sizes
    text = np.empty(int(begins[-1] + sizes[-1] + 1), np.int64)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[:] = -1 - np.arange(len(text))
    text[np.repeat(begins, sizes) + inside] = words[np.repeat(starts, sizes) + inside]
    stretches = _Stretches(text, int(sizes.max()))
    found: list[np.ndarray] = []
    low, high = begins, begins + sizes
    while len(low):
        middle = (low + high) // 2
        periods = (high - low) // MIN_PERIODS
        c = np.repeat(middle, periods)
        q = np.arange(int(periods.sum())) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        for i, j in ((c, c + q), (c - q, c)):
            some = (text[i] == text[j]) | (text[i - 1] == text[j - 1])
            a, b, p = i[some], j[some], q[some]
            start, end = a - stretches.common(a, b, True), b + stretches.common(a, b, False)
            is_run = end - start >= np.maximum(min_length, MIN_PERIODS * p)
            found.append(np.stack([start[is_run], end[is_run], p[is_run]]))
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        large = high - low >= min_length
        low, high = low[large], high[large]
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, length, period = start[new], (end - start)[new], period[new]
    segment = np.searchsorted(begins, start, side="right") - 1
    start = start - begins[segment] + starts[segment]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _chunk(words: list[list[str]], min_length: int) -> list[tuple]:
    """A row of added columns for each document's words."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
    starts, ends = surviving(ids, bounds, min_overlap(min_length))
    start, length, period = main_lorentz(ids, starts, ends, min_length)
    searched = np.bincount(np.searchsorted(bounds, starts, side="right") - 1, ends - starts, len(words)).astype(np.int64)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    first = np.searchsorted(start, bounds)
    rows = []
    for d, ws in enumerate(words):
        a, b = first[d], first[d + 1]
        if a == b:
            rows.append((len(ws), [], [], [], " ".join(ws), 0, int(searched[d])))
        else:
            stay = kept[bounds[d] : bounds[d + 1]].tolist()
            rows.append((len(ws), (start[a:b] - bounds[d]).tolist(), length[a:b].tolist(), period[a:b].tolist(), " ".join(compress(ws, stay)), len(ws) - sum(stay), int(searched[d])))
    return rows


def _maker(min_length: int):
    def make():
        cut = re.compile(WORD_PATTERN)

        def step(texts: list) -> tuple:
            rows: list[tuple] = []
            waiting: list[list[str]] = []
            size = 0
            for text in texts:
                ws = cut.findall(text) if text else []
                if size and size + len(ws) > CHUNK_WORDS:
                    rows += _chunk(waiting, min_length)
                    waiting, size = [], 0
                waiting.append(ws)
                size += len(ws)
            rows += _chunk(waiting, min_length) if waiting else []
            return None, list(zip(*rows, strict=True)) if rows else [[] for _ in ADDED]

        return step

    return make


def periodic_runs(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """Kept columns and, for each document: ``n_words``; ``run_starts``,
    ``run_lengths``, ``run_periods`` (arrays, by start, then period);
    ``collapsed``, the words that are in no run after its first period, joined by
    one space; ``n_dropped``, the words that aren't; ``n_searched``, the words
    that masking left.
    """
    small_batches(docs.sparkSession)
    return map_texts(docs, kept_columns(docs, keep, list(ADDED)), text_column, ADDED, _maker(min_length))


def planted(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of all ids its words with a repeated tail.

    With h = crc32 of the id in decimals and g = h div 10: if h % 10 = 0, every
    word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8). A null id changes nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))

    def tail(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        whole = F.transform(places, lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(whole, " ")).otherwise(F.lit(""))

    # bound to a name by transform, so that the text is cut once and not for each word
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), tail), F.lit(0))).otherwise(text)


def digests(found: DataFrame) -> list[Column]:
    """The runs of ``periodic_runs`` in short: number, strongest run, digests."""
    runs = F.arrays_zip("run_starts", "run_lengths", "run_periods")
    one = F.struct(*[F.lit(None).cast("long").alias(n) for n in ("run_starts", "run_lengths", "run_periods")])
    # strictly more length a period, by whole numbers: of equal ones the first stays
    best = F.reduce(runs, one, lambda x, r: F.when(x["run_starts"].isNull() | (r["run_lengths"] * x["run_periods"] > x["run_lengths"] * r["run_periods"]), r).otherwise(x))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["run_starts"].cast("string"), F.lit(","), r["run_lengths"].cast("string"), F.lit(","), r["run_periods"].cast("string"), F.lit("\n"))), "")
    return [
        F.size("run_starts").cast("long").alias("n_runs"),
        best["run_starts"].alias("start"),
        best["run_lengths"].alias("length"),
        best["run_periods"].alias("period"),
        F.floor(F.lit(1000) * best["run_lengths"] / best["run_periods"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ]
