"""Windows, tiles, pyramid levels and rectangles as column expressions; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roiscore.config import Params


def half_even(x: Column) -> Column:
    """Rounded to the nearest integer, halves to the even one."""
    return F.rint(x).cast("long")


def level0_px(px: int, mpp: Column, p: Params) -> Column:
    """Pixels of the base level that px pixels at the target resolution cover."""
    return half_even(F.lit(float(px)) * F.lit(p.target_mpp) / mpp)


def start_positions(last: Column, stride: Column) -> Column:
    """0, stride, … up to last, and last itself if the steps do not end there."""
    last = F.greatest(last, F.lit(0)).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), last, stride.cast("long"))
    return F.when(F.element_at(steps, -1) == last, steps).otherwise(F.concat(steps, F.array(last)))


def tile_starts(length: Column, patch: int, stride: int) -> Column:
    """Where patches begin so that they cover a length."""
    return start_positions(length - patch, F.lit(stride))


def best_level(levels: Column, mpp_x: Column, p: Params) -> Column:
    """The pyramid level (from 0) whose factor is nearest to the one needed along x, in single precision; the first of equals."""
    target = (F.lit(p.target_mpp) / mpp_x).cast("float")
    return F.array_min(F.transform(levels, lambda d, i: F.struct(F.abs(d.cast("float") - target).alias("off"), i.alias("level"))))["level"]


def effective_mpp(level0: Column, mpp: Column, px: int) -> Column:
    return level0.cast("double") * mpp / F.lit(float(px))


def thumbnail_size(w0: Column, h0: Column, p: Params) -> tuple[Column, Column]:
    scale = F.lit(float(p.thumbnail_max)) / F.greatest(w0, h0)
    return half_even(w0 * scale), half_even(h0 * scale)


def thumbnail_span(start: Column, size: Column, whole: Column, mask: Column) -> tuple[Column, Column]:
    """First pixel and the one after the last, of at least one, that a base-level span covers in the thumbnail."""
    low = F.floor(start / whole * mask)
    first = F.least(F.greatest(low, F.lit(0)), mask - 1)
    after = F.least(F.greatest(F.ceil((start + size) / whole * mask), first + 1), mask)
    return first.cast("long"), after.cast("long")


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A closed ring of five points."""
    x, y, w, h = (c.cast("double") for c in (x, y, w, h))
    return F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h), F.array(x, y))
