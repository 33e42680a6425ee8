"""Reading tables, the shared folder, and views of Arrow text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roiscore.session import ship, small_batches, spread

#: Text handed to numpy at a time; a longer document is handed over alone.
SLICE_BYTES = 1 << 19


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one is set, in local mode alone."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context.getCheckpointDir()


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that operators stage within are removed at the end; what is made of them must have been written by then. Scopes may lie in one another."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and the number of its rows, which are counted as the checkpoint is written."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return done, seen.get["rows"]


#: A key that more than one in so many rows have, and no fewer rows than HOT_ROWS, is hot; so there are no more hot keys than HOT_SHARE.
HOT_SHARE, HOT_ROWS = 1000, 100_000


def hot_keys(counts: DataFrame, total: int, least: int | None = None) -> list[tuple]:
    """[(key, parts)] of the hot keys among (key, rows), which have more than `least` rows (by default HOT_ROWS); there are HOT_SHARE at most."""
    most = max(HOT_ROWS if least is None else least, -(-total // HOT_SHARE))
    return [(key, -(-rows // most)) for key, rows in counts.toDF("key", "rows").where(F.col("rows") > most).toLocalIterator()]


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: list[tuple], by: str, how: str = "inner") -> DataFrame:
    """left joined with right; a hot key's rows are dealt out by the column `by` over several tasks, and its rows on the right (mostly one) go to each."""
    if not hot:
        return left.join(right, key, how)
    kind = next(t for c, t in right.dtypes if c == key)
    parts = F.broadcast(left.sparkSession.createDataFrame(hot, f"_hot {kind}, _parts int"))
    number = lambda df: df.join(parts, F.col(key) == F.col("_hot"), "left").drop("_hot")
    salt = F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return number(left).withColumn("_salt", salt).drop("_parts").join(number(right).withColumn("_salt", copies).drop("_parts"), [key, "_salt"], how).drop("_salt")


def id_and_text(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] | None = None) -> DataFrame:
    """Only the columns an operator needs, under names that no extra column can clash with; null text is empty.

    carry: further columns that go along untouched, as fields of the struct column `carried`.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    more = [] if carry is None else [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def with_carried(schema: str, df: DataFrame) -> T.StructType:
    """The schema, and df's carried column if it has one."""
    return T.StructType([*T._parse_datatype_string(schema).fields, *(T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name == "carried")])


def give_back() -> None:
    """Hand freed memory back to the system: Spark reuses its Python workers, and what one task leaves adds to the next one's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, byte bounds of each row) of runs of rows of about `most` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, stop, data[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]
        at = stop
    give_back()
