"""Names and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(path: Column) -> Column:
    """The last suffix of the file's name in lower case; hidden files without another dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def slide_id(path: Column) -> Column:
    """The file's name without its last suffix, characters that file systems reject replaced."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), r'[<>:"/\\|?*]', "_")
    return F.when(stem == "", "unnamed_slide").otherwise(stem)


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with two decimals (exact halves of a hundredth go up)."""
    return (
        F.when(seconds < 60, F.format_string("%.2f sec", seconds))
        .when(seconds < 3600, F.format_string("%.2f min", seconds / 60))
        .otherwise(F.format_string("%.2f hr", seconds / 3600))
    )


def decision_tag(decision: Column) -> Column:
    return F.when(decision == "direct_accept", "D").otherwise("N")


def roi_name(rank: Column, decision: Column, grid_x: Column, grid_y: Column) -> Column:
    return F.format_string("r%03d_%s_gx%d_gy%d", rank, decision_tag(decision), grid_x, grid_y)
