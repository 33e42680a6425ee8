"""The catalogue of images: which files count, their ids and resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roiscore.config import PARAMS, Params
from roiscore.functions.text import slide_id, suffix

SUMMARY_SCHEMA = "slide_id string, wsi_path string, status string, reason string, error_message string, num_candidate_windows long, num_selected_rois long, num_direct_selected_rois long, num_neighbor_selected_rois long, total_selected_stroma_area_px long, total_tils_inside_stroma_count long, score_mean_percent double, score_stroma_weighted_mean_percent double, score_median_percent double"


def list_slides(spark: SparkSession, folder: str, p: Params = PARAMS) -> DataFrame:
    """Paths and sizes of the image files right in a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("wsi_path"), "length")
    return with_ids(files, p)


def list_tables(spark: SparkSession, folder: str, p: Params = PARAMS) -> DataFrame:
    """Like list_slides, but what has a suffix that counts may be a folder, too, as Spark writes tables: it is one, as large as all files within."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+", "/")
    parent = F.regexp_replace(plain(F.lit(folder)), "/$", "")
    first = F.substring_index(F.substr(plain(F.col("path")), F.length(parent) + 2), "/", 1)
    own = files.groupBy(F.concat(parent, F.lit("/"), first).alias("wsi_path")).agg(F.sum("length").alias("length"))
    return with_ids(own, p)


def with_ids(catalogue: DataFrame, p: Params = PARAMS) -> DataFrame:
    """The catalogue's image files by suffix, each with its slide id."""
    return catalogue.where(suffix(F.col("wsi_path")).isin(*p.extensions)).withColumn("slide_id", slide_id(F.col("wsi_path")))


def with_resolution(slides: DataFrame, p: Params = PARAMS) -> DataFrame:
    """base_mpp_x and base_mpp_y; where either axis lacks its value, both get the fallback."""
    missing = F.col("mpp_x").isNull() | F.col("mpp_y").isNull()
    return slides.withColumns({f"base_mpp_{a}": F.when(missing, F.lit(p.fallback_mpp)).otherwise(F.col(f"mpp_{a}")) for a in "xy"})


def first_of_id(slides: DataFrame) -> DataFrame:
    """Of slides that share an id, the first by path; n_paths tells how many there are."""
    same = Window.partitionBy("slide_id")
    return slides.withColumn("n_paths", F.count("*").over(same)).withColumn("_n", F.row_number().over(same.orderBy("wsi_path"))).where("_n = 1").drop("_n")


def read_summary(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A summary that an earlier run has written; the schema is given, not guessed."""
    reader = spark.read.schema(SUMMARY_SCHEMA)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)
