"""Features for viewers, tables and rasters written out."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roiscore.config import PARAMS, Params
from roiscore.functions import raster
from roiscore.functions.geometry import rectangle
from roiscore.functions.text import roi_name
from roiscore.operators import pixels, rasters
from roiscore.operators.selection import ranked
from roiscore.operators.summary import timing_lines
from roiscore.session import load_folders
from roiscore.sources import folders

MEASURES = ("roi_score", "tumor_fraction", "stroma_fraction", "interface_density", "stroma_area_px", "num_tils_inside_stroma", "roi_tils_score_fraction", "roi_tils_score_percent", "effective_mpp_x_for_scoring", "effective_mpp_y_for_scoring")


def feature(columns: list[str], rank: Column, name: str = "selected_TILs_scoring_ROI", color: tuple[int, int, int] = (0, 0, 255)) -> Column:
    """A GeoJSON feature of a region; measurements that are missing or not a number are left out."""
    measures = F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in MEASURES if m in columns))
    ring = rectangle(*(F.col(c) for c in ("x0_level0", "y0_level0", "w_level0", "h_level0")))
    number = F.format_string("%03d", rank)
    return F.struct(
        F.lit("Feature").alias("type"),
        F.concat(F.lit(f"{name}_"), number).alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(
            F.lit("annotation").alias("objectType"),
            F.concat(F.lit("ROI_"), number).alias("name"),
            F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, color)).alias("color")).alias("classification"),
            F.filter(measures, lambda m: m["value"].isNotNull() & ~F.isnan(m["value"])).alias("measurements"),
            F.lit(False).alias("isLocked"),
            rank.alias("rank"),
            F.col("grid_x").cast("int").alias("grid_x"),
            F.col("grid_y").cast("int").alias("grid_y"),
            F.coalesce("final_decision", F.lit("")).alias("final_decision"),
        ).alias("properties"),
    )


def geojson_features(rois: DataFrame, slide: str = "slide_key") -> DataFrame:
    """(slide, rank, feature): ranked within the slide by the object score from the largest."""
    out = ranked(rois, "roi_tils_score_fraction", "_rank", slide)
    return out.select(slide, F.col("_rank").alias("rank"), feature(rois.columns, F.col("_rank")).alias("feature"))


def write_geojson(rois: DataFrame, folder: str, slide: str = "slide_key", by_line: bool = False) -> None:
    """One collection for each slide, or one feature a line where a slide may have very many."""
    features = geojson_features(rois, slide)
    if by_line:
        rows = features.select(slide, F.to_json("feature").alias("value"))
    else:
        ordered = features.groupBy(slide).agg(F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("f"))
        rows = ordered.select(slide, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("f.feature").alias("features"))).alias("value"))
    rows.write.mode("overwrite").partitionBy(slide).text(folder)


def write_tables(df: DataFrame, folder: str, slide: str = "slide_id", kind: str = "parquet") -> None:
    """One folder for each slide; only the slides in df are replaced.

    Slides are dealt out over a number of tasks, as what counts is files: by their few bytes Spark would put all into one task (and it does so, too,
    where rows lie by slide already: hence by a hash of it). On a local file system tasks make the files themselves (`folders.py`). On others, where there is
    nothing to replace, all are written beside the place and moved there at once, so that the driver does not look for each slide's old folder.
    """
    spark = df.sparkSession
    if kind in folders.SUFFIX and (local := folders.local_path(spark, folder)):
        folders.write_folders(df, local, slide, kind, _tasks(spark))
        return
    rows = df.repartition(_tasks(spark), F.xxhash64(slide)).write.format(kind).partitionBy(slide)
    rows = rows.option("header", True) if kind == "csv" else rows
    place, beside = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (folder, f"{folder.rstrip('/')}-{uuid.uuid4().hex}"))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(folder)
        return
    try:
        rows.save(beside.toString())
        files.mkdirs(place.getParent())
        if not files.rename(beside, place):
            raise OSError(f"{folder} could not be put in place")
    finally:
        files.delete(beside, True)


def read_tables(spark: SparkSession, folder: str, schema: T.StructType, slide: str = "slide_id", kind: str = "parquet") -> DataFrame:
    """What write_tables has written, as the columns of schema. On a local file system tasks list and read the folders, so that the driver holds no list of the files."""
    if kind in folders.SUFFIX and (local := folders.local_path(spark, folder)):
        return folders.read_folders(spark, local, schema, slide, kind, _tasks(spark))
    return load_folders(spark, spark.read.schema(schema).option("header", kind == "csv").format(kind), folder).select(*(f"`{c}`" for c in schema.names))


def _tasks(spark: SparkSession) -> int:
    """Tasks that write or read folders."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def write_timings(totals: DataFrame, folder: str, slide: str = "slide_id") -> None:
    """Stage totals as a table and as lines of text, one folder for each slide."""
    write_tables(totals, f"{folder}/csv", slide, "csv")
    write_tables(timing_lines(totals, slide), f"{folder}/text", slide, "text")


def raster_rows(rois: DataFrame, p: Params = PARAMS, slide: str = "slide_key") -> DataFrame:
    """(slide, kind, name, height, width, channels, data) of the rasters to keep, named after rank, decision and grid.

    Overlays blend the classes and then the objects over the image.
    """
    kinds = ["image"] * p.save_images + ["label", "color", "objects", "stroma", "inside", "clean"] * p.save_masks + ["overlay"] * p.save_overlays
    keep = [slide, "name", "height", "width"]

    def work(row) -> dict:
        shape = (row["height"], row["width"])
        rgb = np.frombuffer(row["rgb"], np.uint8).reshape(*shape, 3)
        label, found, inside, clean = (np.frombuffer(row[c], np.uint8).reshape(shape) for c in ("mask", "objects", "inside", "clean"))
        color = np.zeros((3, 3), np.uint8)
        color[1], color[2] = pixels.TUMOR_RGB, pixels.STROMA_RGB
        classes, marked = color[label], np.where(clean[..., None] == 1, np.array(pixels.OBJECT_RGB, np.uint8), np.uint8(0))
        made = {"image": rgb, "label": label, "color": classes, "objects": found * 255, "stroma": (label == 2).astype(np.uint8) * 255, "inside": inside * 255, "clean": clean * 255}
        if "overlay" in kinds:
            made["overlay"] = raster.overlay(raster.overlay(rgb, classes, 0.30), marked, 0.45)
        return {"files": [{"kind": k, "channels": 3 if made[k].ndim == 3 else 1, "data": made[k].astype(np.uint8).tobytes()} for k in kinds]}

    named = rois.withColumn("name", roi_name(F.col("rank"), F.col("final_decision"), F.col("grid_x"), F.col("grid_y")))
    out = rasters.each_raster(named, work, "files array<struct<kind: string, channels: int, data: binary>>", keep)
    return out.where("error is null").select(slide, "name", "height", "width", F.explode("files").alias("f")).select(slide, "f.kind", "name", "height", "width", "f.channels", "f.data")
