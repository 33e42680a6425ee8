"""Operators on rows that hold a whole raster; each row is worked on in numpy, wherever Spark puts it.

A row has a key, height, width, and rasters as row-major bytes. A row whose work fails keeps its key and gets the text of
the error in `error` instead of results, so that one raster does not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roiscore.config import PARAMS, Params
from roiscore.functions import raster
from roiscore.session import ship

#: Pixels in a batch of pixel rows.
BATCH_PIXELS = 1 << 17


def band(row, name: str, channels: int = 1) -> np.ndarray:
    """A row's raster as an array of its height and width."""
    a = np.frombuffer(row[name], np.uint8)
    return a.reshape(row["height"], row["width"], channels) if channels > 1 else a.reshape(row["height"], row["width"])


def each_raster(df: DataFrame, work: Callable, added: str, keep: list[str], catch: bool = True) -> DataFrame:
    """work(row) -> dict for every row; the columns `keep` go along and `error` is added (without catch, a failure ends the job).

    A row that has an error already (df's own column `error`) keeps it and is not worked on.
    """
    ship(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string(added).fields, T.StructField("error", T.StringType())])
    names = [f.name for f in T._parse_datatype_string(added).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                kept = {c: row[c] for c in keep}
                if isinstance(row.get("error"), str):
                    out.append(kept | dict.fromkeys(names) | {"error": row["error"]})
                    continue
                try:
                    out.append(kept | work(row) | {"error": None})
                except Exception as failure:  # the row's own failure is its result
                    if not catch:
                        raise
                    out.append(kept | dict.fromkeys(names) | {"error": f"{type(failure).__name__}: {failure}"})
            yield pd.DataFrame({f.name: pd.Series([r[f.name] for r in out], dtype=object) for f in schema.fields})

    return df.mapInPandas(run, schema)


def from_pixels(px: DataFrame, key: list[str], bands: dict[str, list[str]]) -> DataFrame:
    """Raster rows from pixel rows on a dense grid; bands names each raster's columns. A raster must fit into one row.

    Pixels of one raster that come near one another are put together as bytes before they are shuffled (some 11 bytes each), and
    a task then goes through its rasters one after another. Pixels may come in any order. A raster with a null place or value, with a value that is no byte, or with pixels that
    are missing or there twice has an `error` and no bands; the others have none.
    """
    ship(px.sparkSession)
    columns = list(dict.fromkeys(c for own in bands.values() for c in own))
    pixel = px.select(*key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.col(c).try_cast("short").alias(c) for c in columns))
    fields = [pixel.schema[c] for c in key]
    sizes = [T.StructField(c, T.LongType()) for c in ("height", "width")]
    data = [T.StructField(c, T.BinaryType()) for c in ("_y", "_x", *(f"_v{n}" for n in range(len(columns))))]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_PIXELS:
                yield _chunks(held, key, columns)
                held = []
        if sum(b.num_rows for b in held):
            yield _chunks(held, key, columns)

    parts = pixel.mapInArrow(chunked, T.StructType([*fields, *sizes, T.StructField("bad", T.BooleanType()), *data]))
    schema = T.StructType([*fields, *(T.StructField(c, T.IntegerType()) for c in ("height", "width")), *(T.StructField(b, T.BinaryType()) for b in bands), T.StructField("error", T.StringType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pixels, types = [], 0, []
        for own, found in groupby(_rows(batches, key, types), lambda row: row[0]):
            height, width, packed, error = _packed([row[1:] for row in found], [[columns.index(c) for c in own] for own in bands.values()])
            out.append((*own, height, width, *packed, error))
            pixels += (height or 0) * (width or 0)
            if pixels >= BATCH_PIXELS:
                yield _table(out, types)
                out, pixels = [], 0
        if out:
            yield _table(out, types)

    def _table(out: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        kinds = [*types, pa.int32(), pa.int32(), *[pa.binary()] * len(bands), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=schema.names)

    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(pack, schema)


def _chunks(batches: list[pa.RecordBatch], key: list[str], columns: list[str]) -> pa.RecordBatch:
    """A row for each key in some batches of pixels: greatest height and width, whether a pixel is bad, and places and values as bytes."""
    px = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    code = np.zeros(px.num_rows, np.int64)
    for c in key:
        found = px.column(c).dictionary_encode("encode")
        code = np.unique(code * len(found.dictionary) + found.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    bad = np.zeros(px.num_rows, bool)
    out = [px.column(c).take(pa.array(order[starts])) for c in key]
    places, values = [], []
    for c in ("y", "x"):
        lost = px.column(c).is_null().to_numpy(zero_copy_only=False)
        bad |= lost
        place = px.column(c).fill_null(-1 << 31).to_numpy()[order]
        most = np.maximum.reduceat(place, starts).astype(np.int64)
        out.append(pa.array(most + 1, mask=most == -1 << 31))
        places.append(place)
    for c in columns:
        value = px.column(c).fill_null(-1).to_numpy()
        bad |= (value < 0) | (value > 255)
        values.append(value.astype(np.uint8)[order])
    out.append(pa.array(np.logical_or.reduceat(bad[order], starts)))
    ends = np.append(starts, px.num_rows)
    for a in (*places, *values):
        out.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * a.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))]))
    return pa.RecordBatch.from_arrays(out, names=[*key, "height", "width", "bad", "_y", "_x", *(f"_v{n}" for n in range(len(columns)))])


def _rows(batches: Iterator[pa.RecordBatch], key: list[str], types: list[pa.DataType]) -> Iterator[tuple]:
    """(key, height, width, bad, data) of each row; the keys' types are put into `types`."""
    for batch in batches:
        types[:] = batch.schema.types[: len(key)]
        keys = zip(*(batch.column(n).to_pylist() for n in range(len(key))))
        plain = (batch.column(len(key) + n).to_pylist() for n in range(3))
        for n, row in enumerate(zip(keys, *plain)):
            yield (*row, [batch.column(c)[n].as_buffer() for c in range(len(key) + 3, batch.num_columns)])


def _packed(parts: list[tuple], bands: list[list[int]]) -> tuple[int | None, int | None, list[bytes | None], str | None]:
    """(height, width, rasters, error) of a raster's chunks; each of `bands` names its values by number."""
    height, width = (max((p[n] for p in parts if p[n] is not None), default=None) for n in (0, 1))
    if any(p[2] for p in parts):
        return height, width, [None] * len(bands), "a pixel has a null place, or a value that is no byte"
    y, x = (np.concatenate([np.frombuffer(p[3][n], np.int32) for p in parts]) for n in (0, 1))
    place = y.astype(np.int64) * width + x
    order = np.argsort(place, kind="stable")
    if not np.array_equal(place[order], np.arange(height * width)):
        return height, width, [None] * len(bands), "pixels are missing, or there twice"
    values = [np.concatenate([np.frombuffer(p[3][n], np.uint8) for p in parts])[order] for n in range(2, len(parts[0][3]))]
    return height, width, [np.stack([values[n] for n in own], axis=-1).tobytes() for own in bands], None


def to_pixels(rasters: DataFrame, key: list[str], bands: list[str], channels: int = 1, most: int = BATCH_PIXELS) -> DataFrame:
    """One row a pixel: the bands' values, or with channels an array of them. Pixels that a band lacks, or all of a null one's, are null; batches hold `most` pixels."""
    ship(rasters.sparkSession)
    flat = rasters.select(*key, "height", "width", *bands)
    value = T.IntegerType() if channels == 1 else T.ArrayType(T.IntegerType())
    schema = T.StructType([*(flat.schema[c] for c in key), T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), *(T.StructField(b, value) for b in bands)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            height, width = (batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("height", "width"))
            ends = np.cumsum(height * width)
            total = int(ends[-1]) if len(ends) else 0
            data = {b: _bytes_of(batch.column(b), ends * channels) for b in bands}
            for first in range(0, total, most):
                i = np.arange(first, min(first + most, total))
                row = np.searchsorted(ends, i, "right")
                y, x = np.divmod(i - (ends - height * width)[row], width[row])
                out = [*(batch.column(c).take(pa.array(row)) for c in key), pa.array(y), pa.array(x)]
                for found, missing in data.values():
                    own = slice(first * channels, (first + len(i)) * channels)
                    numbers = pa.array(found[own].astype(np.int32), mask=missing[own])
                    out.append(numbers if channels == 1 else pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype=np.int32) * channels, numbers))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return flat.mapInArrow(spread, schema)


def _bytes_of(column: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, in which each row ends where `ends` says, and which of them a row lacks."""
    total = int(ends[-1]) if len(ends) else 0
    found, missing = np.zeros(total, np.uint8), np.ones(total, bool)
    for raw, first, stop in zip(column, [0, *ends[:-1].tolist()], ends.tolist()):
        own = np.frombuffer(raw.as_buffer() or b"", np.uint8)[: stop - first]
        found[first : first + len(own)] = own
        missing[first : first + len(own)] = False
    return found, missing


def _tissue(row, p: Params) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(threshold, mask, eroded mask, saturation, value) of a thumbnail's rgb."""
    s, v = raster.saturation_value(band(row, "rgb", 3))
    threshold = max(20, int(0.8 * raster.otsu(np.bincount(s.reshape(-1), minlength=256))))
    mask = ((s > threshold) & (v < 245)).astype(np.uint8)
    mask = raster.closed(raster.opened(mask, p.open_close), p.open_close)
    mask = raster.keep_components(mask, int(p.min_component_share * mask.shape[0] * mask.shape[1]))
    eroded = mask
    if p.use_eroded:
        for _ in range(p.erosion_rounds):
            eroded = raster.erode(eroded, p.erosion, outside=0)
    return threshold, mask, eroded, s, v


def tissue_masks(thumbnails: DataFrame, p: Params = PARAMS, key: list[str] = ("slide_key",)) -> DataFrame:
    """threshold, mask and eroded mask of each thumbnail (rgb)."""

    def work(row) -> dict:
        threshold, mask, eroded, _, _ = _tissue(row, p)
        return {"threshold": threshold, "mask": mask.tobytes(), "eroded": eroded.tobytes()}

    return each_raster(thumbnails, work, "threshold int, mask binary, eroded binary", [*key, "height", "width"])


ZONAL = "filter_global_tissue_fraction double, filter_center_tissue_fraction double, filter_grid_pass_cells int, filter_min_grid_tissue_fraction double, filter_mean_saturation_tissue double, filter_mean_value_tissue double"
_STATS = "stats array<struct<" + ", ".join(c.replace(" ", ": ", 1) for c in ZONAL.split(", ")) + ">>"
RECT = ("mx0", "mx1", "my0", "my1")


def window_stats(thumbnails: DataFrame, rects: Column, keep: list[str], p: Params = PARAMS) -> DataFrame:
    """(keep, error, stats): the foreground of each thumbnail, found once, in each of its windows.

    rects: an array of structs with mx0, mx1, my0, my1 made of columns of the thumbnail's own row, so that neither rasters nor
    windows are shuffled; stats has one entry for each, in order. Running sums make every window cost the same.
    """
    schema = "array<struct<" + ", ".join(f"{c}:bigint" for c in RECT) + ">>"
    given = thumbnails.withColumn("_rects", F.transform(rects, lambda w: F.struct(*(w[c].cast("long").alias(c) for c in RECT))).cast(schema))
    names = [c.split()[0] for c in ZONAL.split(", ")]

    def work(row) -> dict:
        r = {c: np.array([x[c] for x in row["_rects"]], np.int64) for c in RECT}
        _, mask, eroded, s, v = _tissue(row, p)
        inside = eroded if p.use_eroded else mask
        count = raster.window_sums(inside > 0)
        height, width = r["my1"] - r["my0"], r["mx1"] - r["mx0"]

        def share(y0, y1, x0, x1):
            area = (y1 - y0) * (x1 - x0)
            return np.where(area > 0, count(y0, y1, x0, x1) / np.maximum(area, 1), 0.0)

        whole = share(r["my0"], r["my1"], r["mx0"], r["mx1"])
        part = lambda start, size, f: start + (size * f).astype(np.int64)
        center = share(part(r["my0"], height, 0.25), part(r["my0"], height, 0.75), part(r["mx0"], width, 0.25), part(r["mx0"], width, 0.75))
        cut = lambda start, size, k: start + np.rint(k * size / p.grid).astype(np.int64)
        cells = np.stack([share(cut(r["my0"], height, j), cut(r["my0"], height, j + 1), cut(r["mx0"], width, i), cut(r["mx0"], width, i + 1)) for j in range(p.grid) for i in range(p.grid)]).astype(np.float32)
        n = raster.window_sums(mask > 0)(r["my0"], r["my1"], r["mx0"], r["mx1"])
        mean = lambda a, none: np.where(n > 0, raster.window_sums(np.where(mask > 0, a, 0))(r["my0"], r["my1"], r["mx0"], r["mx1"]) / np.maximum(n, 1), none)
        columns = (whole, center, (cells >= p.min_cell_tissue).sum(axis=0), cells.min(axis=0).astype(float), mean(s, 0.0), mean(v, 255.0))
        return {"stats": [dict(zip(names, own)) for own in zip(*(c.tolist() for c in columns))]}

    return each_raster(given, work, _STATS, keep)


def tissue_reason(p: Params = PARAMS):
    """The first rule that a window fails, or pass."""
    c = F.col
    return (
        F.when(c("filter_global_tissue_fraction") < p.min_tissue, "low_global_tissue_fraction")
        .when(c("filter_center_tissue_fraction") < p.min_center_tissue, "low_center_tissue_fraction")
        .when(c("filter_grid_pass_cells") < p.min_cells, "insufficient_grid_tissue_coverage")
        .when(c("filter_mean_saturation_tissue") < p.min_saturation, "low_mean_saturation")
        .when(c("filter_mean_value_tissue") > p.max_value, "high_mean_value_background_like")
        .otherwise("pass")
    )


FEATURES = "tumor_fraction double, stroma_fraction double, background_fraction double, tumor_pixels long, stroma_pixels long, background_pixels long, interface_pixels long, interface_density double, peritumoral_stroma_pixels long, peritumoral_stroma_fraction double"


def label_features(rois: DataFrame, keep: list[str], p: Params = PARAMS) -> DataFrame:
    """Features of each label raster (mask; mpp is its mean resolution)."""

    def work(row) -> dict:
        label, eps = band(row, "mask"), 1e-7
        n = np.bincount(label.reshape(-1), minlength=3)
        rim = int(raster.interface(label).sum())
        near = int((raster.within(label == 1, p.radius_um, row["mpp"]) & (label == 2)).sum())
        total = label.size + eps
        values = (n[1] / total, n[2] / total, n[0] / total, int(n[1]), int(n[2]), int(n[0]), rim, rim / total, near, near / (n[2] + eps) if n[1] else 0.0)
        return dict(zip((c.split()[0] for c in FEATURES.split(", ")), values))

    return each_raster(rois, work, FEATURES, keep)


def segmented(rois: DataFrame, model_factory: Callable[[], Callable], keep: list[str], p: Params = PARAMS, objects: bool = False) -> DataFrame:
    """mask: the best class of each pixel of rgb by a tile model, or with objects its foreground above the threshold.

    The factory makes the model once in each Python worker.
    """
    made: list = []

    def work(row) -> dict:
        if not made:
            made.append(model_factory())
        rgb = band(row, "rgb", 3)
        if objects:
            out = raster.infer(rgb, made[0], p.patch, p.patch_stride, p.batch_tiles, raster.foreground)
            return {"mask": (out >= p.object_threshold).astype(np.uint8).tobytes()}
        return {"mask": np.argmax(raster.infer(rgb, made[0], p.patch, p.patch_stride, p.batch_tiles), axis=-1).astype(np.uint8).tobytes()}

    return each_raster(rois, work, "mask binary", keep)


OBJECTS = "stroma_area_px long, num_tils_inside_stroma long, tils_predicted_area_px_after_filtering long, removed_small_components long, removed_large_components long, tils_watershed_applied boolean, tils_raw_components_before_watershed long, tils_components_after_watershed long, split binary, inside binary, clean binary"


def objects_in_class(rois: DataFrame, keep: list[str], p: Params = PARAMS, cls: int = 2) -> DataFrame:
    """Objects (objects) counted inside a class of the label raster (mask), touching ones set apart before; sizes out of bounds go."""

    def work(row) -> dict:
        label, found = band(row, "mask"), (band(row, "objects") > 0).astype(np.uint8)
        apart = raster.split_touching(found, p.split_at, p.split_rounds) if p.split_touching else found
        inside = apart & (label == cls)
        shaped = raster.opened(inside, p.open_objects) if p.open_objects else inside
        _, area = raster.components(shaped)
        most = p.max_object_px if p.max_object_px is not None else shaped.size
        good = (area >= p.min_object_px) & (area <= most)
        clean = raster.keep_components(shaped, p.min_object_px, p.max_object_px)
        values = (int((label == cls).sum()), int(good.sum()), int(area[good].sum()), int((area < p.min_object_px).sum()), int((area > most).sum()), p.split_touching, len(raster.components(found)[1]), len(raster.components(apart)[1]), apart.tobytes(), inside.astype(np.uint8).tobytes(), clean.tobytes())
        return dict(zip((c.split()[0] for c in OBJECTS.split(", ")), values))

    return each_raster(rois, work, OBJECTS, keep)


def resized(rasters: DataFrame, height: int, width: int, keep: list[str]) -> DataFrame:
    """rgb at another size."""
    return each_raster(rasters, lambda row: {"rgb": raster.resized(band(row, "rgb", 3), height, width).tobytes()}, "rgb binary", keep)
