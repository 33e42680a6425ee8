"""A folder for each slide on a local file system, laid out as Spark's partitionBy does: for very many slides of few rows.

Hadoop starts a chmod there for every folder and file that it makes, unless it has its native library, and Spark's own reader keeps the status of
every file in the driver. Here tasks make, list and read the folders of their slides themselves; nothing of them goes through the driver. What is written can be
read by Spark as well.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roiscore.session import ship

#: Kinds of files, and their suffixes. Rows of csv and text are lines, which Spark itself makes and parses.
SUFFIX = {"parquet": ".snappy.parquet", "csv": ".csv", "text": ".txt"}
#: The folder of rows whose slide is null or empty.
NO_SLIDE = "__HIVE_DEFAULT_PARTITION__"
#: Rows and bytes, about, that a task hands on at once.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 20

_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder on a local file system, None for one on any other."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path).toUri().getPath() if files.getUri().getScheme() == "file" else None


def folder_name(column: str, value: str) -> str:
    """The folder of a value of a column, as Spark names it."""
    escape = lambda text: _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", text)
    return f"{escape(column)}={escape(value)}"


def folder_value(name: str) -> str | None:
    """The value that a folder's name stands for."""
    value = re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name.partition("=")[2])
    return None if value == NO_SLIDE else value


class _Lines:
    """A file of lines."""

    def __init__(self, file, header: list[str]):
        self.file = file
        self.put(header)

    def put(self, lines: list[str]) -> None:
        self.file.write("".join(f"{x}\n" for x in lines).encode())

    def add(self, rows: pa.RecordBatch) -> None:
        self.put(x or "" for x in rows.column(0).to_pylist())

    def close(self) -> None:
        pass


class _Parquet:
    """A file of row groups."""

    def __init__(self, file, schema: pa.Schema):
        self.writer = pq.ParquetWriter(file, schema, compression="snappy")

    def add(self, rows: pa.RecordBatch) -> None:
        self.writer.write_batch(rows)

    def close(self) -> None:
        self.writer.close()


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Stretches of rows of one slide, with the slide, of which the rows have no column."""
    for batch in batches:
        if batch.num_rows:
            rows, runs = batch.drop_columns([column]), pc.run_end_encode(batch.column(column))
            start = 0
            for stop, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                yield value, rows.slice(start, stop - start)
                start = stop


def _write(batches: Iterator[pa.RecordBatch], column: str, kind: str, header: list[str], place: str, scratch: str, name: str) -> int:
    """Files of rows that are sorted by slide; each is written beside and then put in place whole, so that a task may run again."""
    part, mine = f"part-{TaskContext.get().partitionId():05d}-{name}{SUFFIX[kind]}", f"{scratch}/{uuid.uuid4().hex}"
    n, now, file, out = 0, None, None, None

    def finish() -> None:
        out.close()
        file.close()
        folder = f"{place}/{folder_name(column, now)}"
        try:
            os.mkdir(folder)
        except FileExistsError:
            pass
        os.replace(mine, f"{folder}/{part}")

    for value, rows in _runs(batches, column):
        if value != now or out is None:
            if out is not None:
                finish()
            now, n, file = value, n + 1, open(mine, "wb")
            out = _Parquet(file, rows.schema) if kind == "parquet" else _Lines(file, header)
        out.add(rows)
    if out is not None:
        finish()
    return n


def write_folders(rows: DataFrame, path: str, column: str, kind: str, tasks: int) -> None:
    """rows in a folder for each value of column, which is left out of the files; of folders that are there already, those of other values stay.

    All is written beside the path first. A new path appears at once, with all folders; in one that exists, tasks exchange one folder after another.
    A null or empty value has a folder of its own, which reads as null. Columns may have any name; a table without rows gives an empty path, or changes nothing.
    """
    spark = rows.sparkSession
    ship(spark)
    if len(rows.columns) < 2:
        raise ValueError("a table needs columns beside its slides")
    slide, others = F.col(f"`{column}`").cast("string"), [F.col(f"`{c}`") for c in rows.columns if c != column]
    slide, header = F.when(slide.isNull() | (slide == ""), F.lit(NO_SLIDE)).otherwise(slide).alias(column), []
    if kind == "csv":
        header = [_csv_header([c for c in rows.columns if c != column], spark)]
        others = [F.to_csv(F.struct(*others)).alias("_line")]
    dealt = rows.select(*others, slide).repartition(tasks, F.xxhash64(f"`{column}`")).sortWithinPartitions(f"`{column}`")
    beside, name = f"{path}-{uuid.uuid4().hex}", uuid.uuid4().hex
    place, scratch, aside = (f"{beside}/{x}" for x in ("tables", "scratch", "replaced"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _count(_write(batches, column, kind, header, place, scratch, name))

    def exchange(share: int) -> Iterator[pa.RecordBatch]:
        mine = _folders(place, share, tasks)
        for folder in mine:
            if os.path.isdir(f"{path}/{folder}"):
                os.rename(f"{path}/{folder}", f"{aside}/{folder}")
            os.rename(f"{place}/{folder}", f"{path}/{folder}")
        yield _count(len(mine))

    try:
        for folder in (place, scratch, aside):
            os.makedirs(folder)
        dealt.mapInArrow(put, "n long").agg(F.sum("n")).collect()
        if os.path.isdir(path):
            _each_share(spark, tasks, exchange, "n long").agg(F.sum("n")).collect()
        else:
            with open(f"{place}/_SUCCESS", "wb"):
                pass
            os.rename(place, path)
    except BaseException:
        for folder in os.listdir(aside) if os.path.isdir(aside) else ():
            if not os.path.isdir(f"{path}/{folder}"):  # put aside, and its place not taken
                os.rename(f"{aside}/{folder}", f"{path}/{folder}")
        raise
    finally:
        shutil.rmtree(beside, ignore_errors=True)


def _count(n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def _each_share(spark: SparkSession, shares: int, work: Callable[[int], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """What work gives for each share of the folders, a task each."""
    return spark.range(0, shares, 1, shares).mapInArrow(lambda batches: (out for batch in batches for share in batch.column(0).to_pylist() for out in work(share)), schema)


def _csv_header(names: list[str], spark: SparkSession) -> str:
    return spark.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(f"c{n}") for n, c in enumerate(names))))).first()[0]


def _folders(path: str, share: int, shares: int) -> list[str]:
    """The names of one share of the folders of values below a path."""
    with os.scandir(path) as found:
        return sorted(x.name for x in found if "=" in x.name and not x.name.startswith(".") and zlib.crc32(x.name.encode()) % shares == share)


def _read_lines(path: str, header: bool) -> Iterator[pa.RecordBatch]:
    """The lines of a file; of csv neither the first nor blank ones."""
    with open(path, encoding="utf-8", errors="replace", newline="\n") as file:
        if header:
            next(file, None)
        lines, size = [], 0
        for line in file:
            line = line.removesuffix("\n")
            if line.strip() or not header:
                lines.append(line)
                size += len(line)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
                lines, size = [], 0
        if lines:
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})


def _read_parquet(path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a file with the columns asked for; those it lacks are null."""
    with pq.ParquetFile(path) as file:
        there = set(file.schema_arrow.names)
        for batch in file.iter_batches(BATCH_ROWS, columns=[c for c in schema.names if c in there], use_threads=False):
            columns = [batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema) if columns else batch


def read_folders(spark: SparkSession, path: str, schema: T.StructType, column: str, kind: str, tasks: int) -> DataFrame:
    """The rows of all files, with the value of their folder, as the columns of schema; csv files have a header.

    Spark takes them for as few as the shares that they are read from, so joins are told to sort and merge: it would broadcast them.
    """
    ship(spark)
    others = [T.StructField(f.name, f.dataType) for f in schema if f.name != column]
    lines = kind != "parquet"
    made = T.StructType([*([T.StructField("_line", T.StringType())] if lines else others), T.StructField(column, T.StringType())])
    arrow = spark.createDataFrame([], made).toArrow().schema
    inner = pa.schema(list(arrow)[:-1])

    def get(share: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for folder in _folders(path, share, tasks):
            value = folder_value(folder)
            for name in sorted(os.listdir(f"{path}/{folder}")):
                if name.startswith((".", "_")):
                    continue
                file = f"{path}/{folder}/{name}"
                for rows in _read_lines(file, kind == "csv") if lines else _read_parquet(file, inner):
                    held.append(pa.RecordBatch.from_arrays([*rows.columns, pa.array([value] * rows.num_rows, pa.string())], schema=arrow))
                    size += rows.nbytes
                    if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield from _together(held)
                        held, size = [], 0
        yield from _together(held)

    found = _each_share(spark, tasks, get, made)
    if kind == "csv" and others:
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in others)
        found = found.select(F.from_csv("_line", ddl).alias("_line"), f"`{column}`")
    read = {f.name: F.col("_line").getField(f.name) if kind == "csv" else F.col("_line" if lines else f"`{f.name}`") for f in others}
    return found.select(*(read.get(f.name, F.col(f"`{column}`")).cast(f.dataType).alias(f.name) for f in schema)).hint("merge")


def _together(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []
