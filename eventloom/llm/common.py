"""Helpers shared by the operators: reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The space characters of the contracts' word pattern, as a Java regex class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_temporary: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A session on this machine alone may go without: a temporary folder is made
    and set. On a cluster that would lose rows, so there it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _temporary.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="eventloom-"))
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, to be deleted by ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that ran on it, never
    the whole history, and rows that were numbered keep their numbers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark(spark: SparkSession) -> int:
    """What ``release`` takes to delete only what is written from here on."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, mark: int = 0) -> None:
    """Delete the scratch tables of this application, or those since ``mark``.

    For callers that have read or written an operator's result; a result that
    is still to be computed needs its tables.
    """
    paths = _written.get(spark.sparkContext.applicationId, [])
    configuration = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths[mark:]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)
    del paths[mark:]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of one Arrow batch of whole texts; Spark bounds its bytes.

    Operators planned earlier keep their bounds: these only ever get tighter.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, rows if now <= 0 else min(now, rows))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores put before it until no column has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def kept_columns(docs: DataFrame, keep: list[str] | None, own: list[str]) -> list[str]:
    """The columns to pass through: all, or ``keep``, but for those that ``own`` replace."""
    low = {x.lower() for x in own}
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in low]


def packed(columns: list[str]) -> Column:
    """The columns as one struct, ``kept``: no name in it can clash with another."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in columns], *([] if columns else [F.lit(None).cast("int").alias("none")])).alias("kept")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"kept.{quoted(c)}").alias(c) for c in columns]


#: Arrow types of the columns that operators add.
ARROW = {
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "array<long>": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "array<int>": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
}


def map_texts(docs: DataFrame, kept: list[str], text_column: str, added: dict[str, str], make: Callable[[], Callable[[list], tuple]]) -> DataFrame:
    """Kept columns and columns made of the texts, batch by batch through Arrow.

    ``make`` is called once a task and gives a function from a batch's texts to
    (rows, columns): the places of the batch's rows that the new rows come from,
    None for all in order, and the values of the ``added`` columns. Kept columns
    are passed on as they are, so large and missing integers stay exact.
    """
    kinds = [ARROW[t][1] for t in added.values()]
    plain = [f"c{i}" for i in range(len(kept) + len(added))]  # any name may stand in ``kept``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows, columns = step(batch.column(len(kept)).to_pylist())
            own = [batch.column(i) if rows is None else batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], plain)

    kept_types = [docs.schema[c].dataType for c in kept]
    fields = [T.StructField(n, t) for n, t in zip(plain, [*kept_types, *[ARROW[t][0] for t in added.values()]], strict=True)]
    sent = docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(kept, plain, strict=False)], F.col(quoted(text_column)).cast("string").alias("text"))
    return sent.mapInArrow(run, T.StructType(fields)).toDF(*kept, *added)


BITMAP_BITS = 1 << 23


def bitmap_split(rows: DataFrame, key: str, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose 64-bit ``key`` may be among those in ``marked``, the others).

    The keys set bits in a bitmap of ``BITMAP_BITS``, sent to all tasks as rows of
    64 bits: 131,072 rows at most, whatever there is marked. Rows without a bit
    surely aren't marked and need no shuffle. The more is marked the fewer go
    that way; which rows are marked an exact join has to say.
    """
    place, word, mask = (fresh(n, rows.columns) for n in ("__bit", "__word", "__mask"))
    bit = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    words = (
        marked.select(bit.alias(place))
        .groupBy(F.floor(F.col(place) / 64).alias(word))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 as int))")).alias(mask))
    )
    words = staged(words, "bitmap")
    tested = rows.withColumn(place, bit).withColumn(word, F.floor(F.col(place) / 64)).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.expr(f"({mask} & shiftleft(1L, cast({place} % 64 as int))) <> 0"), F.lit(False))
    columns = [F.col(quoted(c)) for c in rows.columns]
    return tuple(tested.filter(t).select(*columns) for t in (hit, ~hit))


def hashable(rows: DataFrame) -> list[str]:
    """The columns that Spark can hash: those that hold no map (or a variant)."""
    return [quoted(f.name) for f in rows.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]


HOT_KEYS = 1024


def skew_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined (inner, left_semi or left) with ``table``, one row a key.

    ``weight``: how many of ``rows`` have that key; ``total``: the sum of all, if
    known. Keys with over 1 / HOT_KEYS of all the weight are fewer than HOT_KEYS,
    so they are sent to all tasks, and their rows are spread over the shuffle;
    of the others none holds more than that share. Whatever the keys, no task
    gets a group much larger than a thousandth of the rows.
    """
    taken = [*rows.columns, *table.columns]
    few, many, salt, everything = (fresh(n, taken) for n in ("few", "many", "salt", "all"))
    values = [c for c in table.columns if c not in keys and c != weight]
    if total is None:
        weighed = table.join(F.broadcast(table.agg(F.sum(weight).alias(everything))))  # one row
    else:
        weighed = table.withColumn(everything, F.lit(total))
    is_hot = F.col(weight) * HOT_KEYS > F.col(everything)
    value = F.struct(F.lit(True).alias("found"), *values)
    hot = weighed.filter(is_hot).select(*keys, value.alias(few))
    cold = weighed.filter(~is_hot).select(*keys, F.lit(0).alias(salt), value.alias(many))
    spread = F.when(F.col(few).isNull(), 0).otherwise(F.pmod(F.xxhash64(*hashable(rows)), F.lit(HOT_KEYS)).cast("int") + 1)
    both = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, spread).join(cold, [*keys, salt], "left")
    if how != "left":
        both = both.filter(F.col(few).isNotNull() | F.col(many).isNotNull())
    found = [F.coalesce(F.col(few)[c], F.col(many)[c]).alias(c) for c in values] if how != "left_semi" else []
    return both.select(*rows.columns, *found)
