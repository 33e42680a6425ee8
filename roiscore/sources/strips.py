"""Rasters in files of horizontal strips, as a Spark data source: a read opens only the files, and reads only the strips, that its filters leave; windows are read by themselves.

A file has the letters RSTR, four little-endian unsigned 32-bit numbers (height, width, channels, rows in a strip), and then
the strips from the top, each row-major bytes; the last may be lower.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from roiscore.operators.rasters import each_raster
from roiscore.session import ship

MAGIC, HEAD, SUFFIX = b"RSTR", struct.Struct("<4s4I"), ".rst"
#: Bytes of files that one task reads, about.
SPLIT = 64 << 20
SCHEMA = "name string, height int, width int, channels int, y0 int, rows int, data binary"
_ARROW = pa.schema([("name", pa.string()), *((c, pa.int32()) for c in ("height", "width", "channels", "y0", "rows")), ("data", pa.binary())])


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Layout:
    height: int
    width: int
    channels: int
    rows: int

    @staticmethod
    def of(file) -> Layout:
        magic, *numbers = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC or not numbers[3]:
            raise ValueError("not a file of strips")
        return Layout(*numbers)

    @property
    def line(self) -> int:
        return self.width * self.channels

    def start(self, y: int) -> int:
        return HEAD.size + y * self.line


@dataclass
class Split(InputPartition):
    """Parts of files: of each the strips that begin at a byte from `first` to before `stop`."""

    parts: list[tuple[str, int, int]]

    def __init__(self, parts):
        super().__init__(None)
        self.parts = parts


class StripReader(DataSourceReader):
    """Filters on name and y0 are taken over exactly; Spark applies all others."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.names: set[str] | None = None
        self.low, self.high = 0, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("name",) and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            elif column == ("y0",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self.high = min(self.high, f.value + 1)
            elif column == ("y0",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Split]:
        system, folder = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(folder)) if self.names is None else system.get_file_info([f"{folder}/{n}{SUFFIX}" for n in sorted(self.names)])
        out: list[Split] = [Split([])]
        room = self.split
        for info in found:
            if info.type != fs.FileType.File or not info.path.endswith(SUFFIX) or info.base_name.startswith("."):
                continue
            for first in range(0, info.size, self.split):
                stop = min(first + self.split, info.size)
                if room < stop - first:
                    out.append(Split([]))
                    room = self.split
                out[-1].parts.append((info.path, first, stop))
                room -= stop - first
        return [s for s in out if s.parts] or out[:1]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        for path, first, stop in partition.parts:
            with _open(system, path) as file:
                at = Layout.of(file)
                name = path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
                begin = -(-max(self.low, 0) // at.rows) * at.rows
                for y in range(begin, min(self.high, at.height), at.rows):
                    if first <= at.start(y) < stop:
                        rows = min(at.rows, at.height - y)
                        file.seek(at.start(y))
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, at.height, at.width, at.channels, y, rows, file.read(rows * at.line)), _ARROW.types)], schema=_ARROW)


class StripWriter(DataSourceWriter):
    """A file for each row (name, height, width, channels, data): written beside, then renamed, so that a task that is run again leaves whole files."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        for row in iterator:
            data = bytes(row.data)
            if len(data) != row.height * row.width * row.channels:
                raise ValueError(f"{row.name} has {len(data)} bytes, not {row.height} x {row.width} x {row.channels}")
            beside = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(beside) as out:
                out.write(HEAD.pack(MAGIC, row.height, row.width, row.channels, self.rows))
                out.write(data)
            system.move(beside, f"{folder}/{row.name}{SUFFIX}")
        return WriterCommitMessage()


class RasterStrips(DataSource):
    """Options: path; rows (of a strip, when writing); split (bytes a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "rasterstrips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StripReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StripWriter(self.options["path"], int(self.options.get("rows", 256)))


def _open(system: fs.FileSystem, path: str):
    return system.open_input_file(path)


def _registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(RasterStrips)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_strips(rasters: DataFrame, path: str, rows: int = 256) -> None:
    """Rows (name, height, width, channels, data) as files in a folder; names must be unique."""
    _registered(rasters.sparkSession)
    rasters.select("name", "height", "width", "channels", "data").write.format("rasterstrips").option("rows", rows).mode("append").save(path)


def read_strips(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The strips of a folder's files; where() on name (equal, in) and y0 (bounds) decides what is read at all."""
    return _registered(spark).read.format("rasterstrips").option("split", split).load(path)


def window_of(path: str, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """A window of a file, from the lines that it covers alone; what lies outside of the raster is 0."""
    system, inner = _file_system(path)
    with _open(system, inner) as file:
        at = Layout.of(file)
        out = np.zeros((height, width, at.channels), np.uint8)
        top, bottom, left, right = max(y0, 0), min(y0 + height, at.height), max(x0, 0), min(x0 + width, at.width)
        if top < bottom and left < right:
            file.seek(at.start(top))
            lines = np.frombuffer(file.read((bottom - top) * at.line), np.uint8).reshape(bottom - top, at.width, at.channels)
            out[top - y0 : bottom - y0, left - x0 : right - x0] = lines[:, left:right]
    return out


def read_windows(windows: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """(keep, height, width, rgb, error) of windows (name, x0, y0, w, h), read where the windows are: a task reads the lines of its own windows only. A file that is missing or no strips is an error of its windows."""

    def work(row) -> dict:
        px = window_of(f"{path}/{row['name']}{SUFFIX}", *(int(row[c]) for c in ("x0", "y0", "w", "h")))
        return {"height": px.shape[0], "width": px.shape[1], "rgb": px.tobytes()}

    return each_raster(windows, work, "height int, width int, rgb binary", keep)
