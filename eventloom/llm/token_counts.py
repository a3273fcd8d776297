"""Token counts without token ids, for a sentencepiece BPE vocabulary.

A merge can only build pieces of the vocabulary. Where no piece holds two
neighbouring characters, no merge crosses between them, so a text falls apart
into *pre-tokens* whose pieces can be counted alone. For the vocabulary used
here that is so before every run of word-start marks, and not between letters and
other characters, as it has a piece that mixes them; the pieces of the model are
searched to be sure, and a vocabulary without mixed pieces is cut there as well.

1. Distinct pre-tokens of all texts are gathered with the number of texts they
   are in, summed up in each task before they are moved.
2. The pieces of every distinct pre-token are counted, once.
3. Counts are joined to the per-document frequencies and summed. The ``HEAD``
   most widespread pre-tokens of at most ``HEAD_CHARS`` characters, a bounded
   table, are sent to all tasks and joined there; all others are joined on a
   64-bit hash (equal hashes are taken for equal pre-tokens), the most frequent
   of them apart, so that a long pre-token in very many texts is no hot key.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted alike; an empty table gives an empty result; other columns pass
through if named in ``keep``, unless they carry one of the added names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, kept_columns, map_texts, quoted, skew_join, small_batches, staged

HEAD = 1 << 18
HEAD_CHARS = 64
FLUSH = 200_000
LIMIT = 4096
FINE = r"[ ▁]*[^\W\d_]+|[ ▁]*(?:[\d_]|[^\w ▁])+|[ ▁]+"
COARSE = r"[ ▁]*[^ ▁]+|[ ▁]+"
GUARD = "\n"


def pretoken_pattern(model_file: str) -> str:
    """The finest cut that no piece of the model crosses."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    letter = re.compile(r"[^\W\d_]")
    if any(GUARD in p for p in pieces) or any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("this vocabulary has pieces that go on past a word start")
    mixed = any(bool(letter.match(a)) != bool(letter.match(b)) for p in pieces for a, b in zip(p, p[1:], strict=False) if "▁" not in (a, b))
    return COARSE if mixed else FINE


def pretokens(cut: re.Pattern, text: str | None) -> Counter:
    """Pre-token frequencies of a text; the model puts a word start before it."""
    return Counter(cut.findall(" " + text)) if text else Counter()


def _key(pretoken: str) -> int:
    x = xxhash.xxh64_intdigest(pretoken.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _gather(pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, found = re.compile(pattern), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                found.update(pretokens(cut, text).keys())
                if len(found) > FLUSH:
                    yield pd.DataFrame({"pretoken": list(found.keys()), "texts": list(found.values())})
                    found = Counter()
        if found:
            yield pd.DataFrame({"pretoken": list(found.keys()), "texts": list(found.values())})

    return run


def _count_pieces(model_file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        # The guard keeps the model's own word start off; it merges with nothing.
        base = len(model.encode(GUARD))
        for pdf in batches:
            ids = model.encode([GUARD + x for x in pdf["pretoken"]], num_threads=1)
            yield pd.DataFrame({"pretoken": pdf["pretoken"], "texts": pdf["texts"], "key": [_key(x) for x in pdf["pretoken"]], "pieces": [len(x) - base for x in ids]})

    return run


def most_widespread(counted: DataFrame, head: int) -> DataFrame:
    """The pre-tokens in the most texts, at most ``head`` of them.

    A histogram of ``texts`` in eighths of a power of two, a few hundred rows,
    gives the limit; no ranking of the whole table is made.
    """
    step = F.floor(F.log2("texts") * 8).cast("int")
    bins = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    taken, least = 0, None
    for row in sorted(bins, key=lambda r: -r["step"]):
        if taken + row["n"] > head:
            break
        taken, least = taken + row["n"], row["step"]
    return counted.filter(F.lit(False) if least is None else step >= least)


def count_tokens(docs: DataFrame, model_file: str, text_column: str = "text", keep: list[str] | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to every row."""
    spark = docs.sparkSession
    own = ["n_bytes", "n_tokens", "over_limit"]
    kept = kept_columns(docs, keep, own)
    row_id, head_sum, keys_of, times_of = (fresh(n, kept) for n in ("row", "head", "keys", "times"))
    pattern = pretoken_pattern(model_file)
    small_batches(spark, 5000)
    texts = docs.select(F.col(quoted(text_column)).cast("string").alias("text"))
    distinct = texts.mapInPandas(_gather(pattern), "pretoken string, texts long").groupBy("pretoken").agg(F.sum("texts").alias("texts"))
    counted = staged(distinct.mapInPandas(_count_pieces(model_file), "pretoken string, texts long, key long, pieces int"), "pretokens")
    top = most_widespread(counted.filter(F.length("pretoken") <= HEAD_CHARS), head).select("pretoken", "pieces").toArrow()
    common = spark.sparkContext.broadcast(dict(zip(top["pretoken"].to_pylist(), top["pieces"].to_pylist(), strict=True)))  # at most HEAD rows of HEAD_CHARS

    small_batches(spark, 1000)

    def make():
        cut, pieces_of = re.compile(pattern), common.value.get

        def measure(texts: list) -> tuple:
            sizes, heads, keys, times = [], [], [], []
            for text in texts:
                total, own_keys, own_times = 0, [], []
                for pretoken, n in pretokens(cut, text).items():
                    pieces = pieces_of(pretoken)
                    if pieces is None:
                        own_keys.append(_key(pretoken))
                        own_times.append(n)
                    else:
                        total += pieces * n
                sizes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                heads.append(total)
                keys.append(own_keys)
                times.append(own_times)
            return None, [sizes, heads, keys, times]

        return measure

    measured = map_texts(docs, kept, text_column, {"n_bytes": "long", head_sum: "long", keys_of: "array<long>", times_of: "array<int>"}, make)
    measured = staged(measured.withColumn(row_id, F.monotonically_increasing_id()), "token-heads")
    rest = measured.select(F.col(row_id).alias("row"), F.explode(F.arrays_zip(F.col(keys_of).alias("key"), F.col(times_of).alias("times"))).alias("t")).select("row", "t.key", "t.times")
    pieces = counted.groupBy("key").agg(F.max("pieces").alias("pieces"), F.sum("texts").alias("texts"))
    tails = skew_join(rest, pieces, ["key"], "texts").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("tail"))
    tails = tails.select(F.col("row").alias(fresh("row2", kept)), F.col("tail").alias(fresh("tail", kept)))
    total = (F.col(head_sum) + F.coalesce(fresh("tail", kept), F.lit(0))).cast("long")
    out = measured.drop(keys_of, times_of).join(tails, F.col(row_id) == F.col(fresh("row2", kept)), "left")
    return out.select(*[F.col(quoted(c)) for c in kept], "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
