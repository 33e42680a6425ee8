"""Connected components of rasters that do not fit into one row: tiles are labelled alone, and labels that meet at a seam are united.

A tile row has a key, the place of its first pixel (y0, x0) in a raster `full_width` wide, height, width and a mask. A
component goes by the number of its first pixel in the whole raster, y * full_width + x.

Tables of labels and edges are small as files, but not in rows; so their joins sort and merge, whatever Spark makes of their size, and
nothing of them is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiscore.functions import raster
from roiscore.operators.rasters import band, each_raster

def _own_components(row, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, areas, the number of each label's first pixel) of a tile."""
    label, area = raster.components(band(row, mask))
    y, x = np.nonzero(label)
    first = np.full(len(area) + 1, -1, np.int64)
    first[label[y, x][::-1]] = ((y + row["y0"]) * row["full_width"] + x + row["x0"])[::-1]
    return label, area, first


_LABELS = "parts array<struct<first: bigint, area: bigint>>, rim array<struct<y: bigint, x: bigint, first: bigint>>"


def labelled(tiles: DataFrame, key: list[str], mask: str = "mask") -> DataFrame:
    """(key, y0, x0, parts, rim, error): each tile's own components with their areas, and the pixels on its edges with the component they lie in."""

    def work(row) -> dict:
        label, area, first = _own_components(row, mask)
        y, x = np.nonzero(label)
        edge = (y == 0) | (x == 0) | (y == label.shape[0] - 1) | (x == label.shape[1] - 1)
        rim = zip((y[edge] + row["y0"]).tolist(), (x[edge] + row["x0"]).tolist(), first[label[y[edge], x[edge]]].tolist())
        return {"parts": [{"first": f, "area": a} for f, a in zip(first[1:].tolist(), area.tolist())], "rim": [{"y": a, "x": b, "first": c} for a, b, c in rim]}

    return each_raster(tiles, work, _LABELS, [*key, "y0", "x0"])


def seams(labels: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, b): pairs of components of different tiles with pixels side by side or corner to corner; a < b. An equi-join of edge pixels with the places around them."""
    rim = labels.select(*key, F.explode("rim").alias("p")).select(*key, "p.*")
    around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    asking = rim.withColumn("d", around).select(*key, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), F.col("first").alias("other"))
    met = asking.join(rim.hint("merge"), [*key, "y", "x"]).where("first <> other")
    return met.select(*key, F.least("first", "other").alias("a"), F.greatest("first", "other").alias("b")).distinct()


def united(edges: DataFrame, key: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, first, root): the smallest component that each component of the edges (key, a, b) is joined with.

    Rounds of two steps: every component's larger neighbours, and then its smaller ones, are tied to the smallest of them, until
    nothing changes; so each group ends as a star. keep: stores a table and reads it back, once a round.
    """
    now, seen = keep(edges), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*key, "a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(*key, F.col("b").alias("first"), F.col("a").alias("root"))
        seen = state
        both = now.select(*key, F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(*key, F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy(*key, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), [*key, "u"]).where("v > u").select(*key, F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        least = large.groupBy(*key, "b").agg(F.min("a").alias("m"))
        small = large.join(least.hint("merge"), [*key, "b"])
        now = keep(small.where("a <> m").select(*key, F.col("m").alias("a"), F.col("a").alias("b")).unionAll(least.select(*key, F.col("m").alias("a"), "b")).distinct())


def tiled_components(tiles: DataFrame, key: list[str], keep: Callable[[DataFrame], DataFrame], mask: str = "mask") -> tuple[DataFrame, DataFrame]:
    """((key, first, area), (key, y0, x0, first, root)): the 8-connected components of whole rasters, wherever they are cut, and the component that each part in a tile belongs to.

    Only labels and edge pixels leave a tile. A tile that fails has no parts; its raster's other tiles are united without it.
    """
    labels = keep(labelled(tiles, key, mask)).where("error is null")
    roots = united(seams(labels, key), key, keep)
    parts = labels.select(*key, "y0", "x0", F.explode("parts").alias("p")).select(*key, "y0", "x0", "p.*")
    parts = keep(parts.join(roots.hint("merge"), [*key, "first"], "left").withColumn("root", F.coalesce("root", "first")))
    areas = parts.groupBy(*key, F.col("root").alias("first")).agg(F.sum("area").alias("area"))
    return areas, parts.select(*key, "y0", "x0", "first", "root")


def tiled_keep_components(tiles: DataFrame, key: list[str], least: int, keep: Callable[[DataFrame], DataFrame], most: int | None = None, mask: str = "mask") -> DataFrame:
    """(key, y0, x0, height, width, mask, error): the tiles with only those pixels whose component has least to most pixels over the whole raster."""
    areas, parts = tiled_components(tiles, key, keep, mask)
    good = areas.where(F.col("area").between(least, most if most is not None else 1 << 62)).select(*key, F.col("first").alias("root"))
    good = parts.join(good.hint("merge"), [*key, "root"], "left_semi").groupBy(*key, "y0", "x0").agg(F.collect_list("first").alias("good"))

    def work(row) -> dict:
        label, _, first = _own_components(row, mask)
        good = np.isin(first, np.array(row["good"] if row["good"] is not None else [], np.int64))
        return {"mask": good[label].astype(np.uint8).tobytes()}

    given = tiles.select(*key, "y0", "x0", "height", "width", "full_width", mask).join(good.hint("merge"), [*key, "y0", "x0"], "left")
    return each_raster(given, work, "mask binary", [*key, "y0", "x0", "height", "width"])
