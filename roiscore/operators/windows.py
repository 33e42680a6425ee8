"""Candidate windows, read plans and tile plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roiscore.config import PARAMS, Params
from roiscore.functions import geometry as g


def candidate_windows(slides: DataFrame, p: Params = PARAMS) -> DataFrame:
    """One row for each window of a slide's grid, by row and column; the last row and column end at the slide's edge.

    With max_windows, only the first so many of each slide: by arithmetic on the grid, without a shuffle.
    """
    size = {a: g.level0_px(p.roi_px, F.col(f"base_mpp_{a}"), p) for a in "xy"}
    stride = {a: g.level0_px(p.stride_px, F.col(f"base_mpp_{a}"), p) for a in "xy"}
    out = slides.withColumns({"w_level0": size["x"], "h_level0": size["y"]})
    out = out.withColumns({"_xs": g.start_positions(F.col("slide_w0") - F.col("w_level0"), stride["x"]), "_ys": g.start_positions(F.col("slide_h0") - F.col("h_level0"), stride["y"])})
    out = out.withColumn("_columns", F.size("_xs"))
    out = out.select("*", F.posexplode("_ys").alias("grid_y", "y0_level0")).select("*", F.posexplode("_xs").alias("grid_x", "x0_level0"))
    if p.max_windows is not None:
        out = out.where(F.col("grid_y").cast("long") * F.col("_columns") + F.col("grid_x") < p.max_windows)
    return out.withColumns({c: F.col(c).cast("long") for c in ("grid_x", "grid_y")}).drop("_xs", "_ys", "_columns")


def read_plan(slides: DataFrame, p: Params = PARAMS) -> DataFrame:
    """How a region of each slide is read: its size at the base level, the pyramid level, the size there, the resolution that results, and the thumbnail's size."""
    level = g.best_level(F.col("level_downsamples"), F.col("base_mpp_x"), p)
    out = slides.withColumns({"region_w0": g.level0_px(p.roi_px, F.col("base_mpp_x"), p), "region_h0": g.level0_px(p.roi_px, F.col("base_mpp_y"), p), "level": level})
    down = F.element_at("level_downsamples", F.col("level") + 1)
    thumb_w, thumb_h = g.thumbnail_size(F.col("slide_w0"), F.col("slide_h0"), p)
    return out.withColumns({
        "read_w": F.ceil(F.col("region_w0") / down).cast("long"),
        "read_h": F.ceil(F.col("region_h0") / down).cast("long"),
        "effective_mpp_x": g.effective_mpp(F.col("region_w0"), F.col("base_mpp_x"), p.roi_px),
        "effective_mpp_y": g.effective_mpp(F.col("region_h0"), F.col("base_mpp_y"), p.roi_px),
        "thumb_w": thumb_w,
        "thumb_h": thumb_h,
    })


def tile_plan(rasters: DataFrame, p: Params = PARAMS, width: str = "width", height: str = "height") -> DataFrame:
    """The tiles that cover each raster, by row and column, with the part of each that lies in it."""
    tiles = rasters.select("*", F.explode(g.tile_starts(F.col(height), p.patch, p.patch_stride)).alias("tile_y")).select("*", F.explode(g.tile_starts(F.col(width), p.patch, p.patch_stride)).alias("tile_x"))
    return tiles.withColumns({"valid_h": F.least(F.lit(p.patch), F.col(height) - F.col("tile_y")), "valid_w": F.least(F.lit(p.patch), F.col(width) - F.col("tile_x"))})


def thumbnail_rects(windows: DataFrame) -> DataFrame:
    """mx0, mx1, my0, my1: the pixels of the thumbnail (thumb_w x thumb_h) that each window covers."""
    mx0, mx1 = g.thumbnail_span(F.col("x0_level0"), F.col("w_level0"), F.col("slide_w0"), F.col("thumb_w"))
    my0, my1 = g.thumbnail_span(F.col("y0_level0"), F.col("h_level0"), F.col("slide_h0"), F.col("thumb_h"))
    return windows.withColumns({"mx0": mx0, "mx1": mx1, "my0": my0, "my1": my1})


def with_window_array(slides: DataFrame, p: Params = PARAMS) -> DataFrame:
    """slides (with thumb_w, thumb_h) with `windows`: those of candidate_windows and their thumbnail_rects, as one array a slide."""
    size = {a: g.level0_px(p.roi_px, F.col(f"base_mpp_{a}"), p) for a in "xy"}
    stride = {a: g.level0_px(p.stride_px, F.col(f"base_mpp_{a}"), p) for a in "xy"}
    out = slides.withColumns({"w_level0": size["x"], "h_level0": size["y"]})
    xs = g.start_positions(F.col("slide_w0") - F.col("w_level0"), stride["x"])
    ys = g.start_positions(F.col("slide_h0") - F.col("h_level0"), stride["y"])

    def window(x: Column, gx: Column, y: Column, gy: Column) -> Column:
        mx = g.thumbnail_span(x, F.col("w_level0"), F.col("slide_w0"), F.col("thumb_w"))
        my = g.thumbnail_span(y, F.col("h_level0"), F.col("slide_h0"), F.col("thumb_h"))
        named = {"grid_x": gx, "grid_y": gy, "x0_level0": x, "y0_level0": y, "mx0": mx[0], "mx1": mx[1], "my0": my[0], "my1": my[1]}
        return F.struct(*(v.cast("long").alias(k) for k, v in named.items()))

    found = F.flatten(F.transform(ys, lambda y, gy: F.transform(xs, lambda x, gx: window(x, gx, y, gy))))
    return out.withColumn("windows", found if p.max_windows is None else F.slice(found, 1, p.max_windows))


def windows_of_pixels(px: DataFrame, windows: DataFrame, key: list[str], cell: int) -> DataFrame:
    """px joined with every window that it lies in; windows (key, x0, x1, y0, y1, any more) are half open and may overlap.

    A range join as an equi-join: the plane is cut into cells, a window goes to every cell that it touches, a pixel to
    its own, and the bounds are checked within. Cells about as large as windows send each to four of them. Empty windows and
    pixels in no window are left out.
    """
    cells = lambda a: F.sequence(F.floor(F.col(f"{a}0") / cell), F.floor((F.col(f"{a}1") - 1) / cell))
    spread = windows.where("x1 > x0 and y1 > y0").withColumn("_cy", F.explode(cells("y"))).withColumn("_cx", F.explode(cells("x")))
    own = px.withColumns({"_cy": F.floor(F.col("y") / cell), "_cx": F.floor(F.col("x") / cell)})
    return own.join(spread, [*key, "_cy", "_cx"]).where("x >= x0 and x < x1 and y >= y0 and y < y1").drop("_cy", "_cx")
