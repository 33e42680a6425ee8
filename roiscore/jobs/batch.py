"""The jobs from end to end, over the tables of many slides at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiscore.config import PARAMS, Params
from roiscore.functions import geometry
from roiscore.operators import rasters, scoring, selection, summary, windows
from roiscore.sources import catalogue

KEY = ["slide_id", "grid_x", "grid_y"]
#: Region keys with their numbers (some 100 bytes each) that may be sent to all rasters; more are joined by a shuffle.
MOST_BROADCAST = 500_000


@dataclass
class Selection:
    """What region selection leaves: all windows' reasons, the passing regions with features and decisions, their label rasters, failures."""

    windows: DataFrame
    decisions: DataFrame
    labels: DataFrame
    failed: DataFrame


def _sent(df: DataFrame) -> DataFrame:
    """df to be broadcast if its rows, which are counted, are few; then the rasters it is joined with stay where they are read."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


_SLIDE = ["slide_id", "slide_w0", "slide_h0", "base_mpp_x", "base_mpp_y"]


def screened_slides(slides: DataFrame, thumbnails: DataFrame, p: Params = PARAMS) -> DataFrame:
    """(slide_id, sizes and resolutions, error, stats): each thumbnail masked once, with the statistics of every window of its slide's grid.

    thumbnails: slide_id, height, width, rgb. The grid is arithmetic on a slide's columns, and slides are small rows; so
    they go to the thumbnails, and no raster is shuffled (but where there are more slides than may be broadcast). A slide without a thumbnail has an error.
    """
    sizes = slides.select(*_SLIDE)
    sized = thumbnails.join(_sent(sizes), "slide_id").withColumns({"thumb_w": F.col("width").cast("long"), "thumb_h": F.col("height").cast("long")})
    sized = windows.with_window_array(sized, p)
    found = rasters.window_stats(sized, F.col("windows"), [*_SLIDE, "thumb_w", "thumb_h"], p)
    missing = sizes.join(thumbnails.select("slide_id"), "slide_id", "left_anti").withColumn("error", F.lit("no thumbnail"))
    return found.unionByName(missing, allowMissingColumns=True)


def screened_windows(screened: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Every candidate window of the screened slides, with the statistics of the foreground in it and the reason that it passes or not; a slide that failed has one row, without a window."""
    rows = windows.with_window_array(screened, p).withColumn("w", F.explode_outer(F.arrays_zip("windows", "stats")))
    rows = rows.select(*_SLIDE, "w_level0", "h_level0", "error", "w.windows.*", "w.stats.*")
    return rows.withColumn("filter_reason", F.when(F.col("error").isNull(), rasters.tissue_reason(p)))


def select_rois(slides: DataFrame, thumbnails: DataFrame, regions: DataFrame, model: Callable[[], Callable], keep: Callable[[DataFrame], DataFrame], p: Params = PARAMS) -> Selection:
    """Slides to decided regions.

    slides: slide_id, wsi_path, slide_w0, slide_h0, base_mpp_x, base_mpp_y. regions: slide_id, grid_x, grid_y, height, width, rgb.
    keep: stores a table and gives it back read; it is used for all that is computed from rasters, so that each of them is masked,
    segmented and measured once. A slide without a thumbnail and a passing window without a raster are failures, as rasters that can't be read are.
    """
    screened = screened_windows(keep(screened_slides(slides, thumbnails, p)), p)
    passed = screened.where("filter_reason = 'pass'")
    plan = passed.select(*KEY, "filter_global_tissue_fraction", "w_level0", "h_level0", "base_mpp_x", "base_mpp_y")
    rois = regions.join(_sent(plan), KEY).withColumns({f"effective_mpp_{a}": geometry.effective_mpp(F.col(f"{s}_level0"), F.col(f"base_mpp_{a}"), p.roi_px) for a, s in (("x", "w"), ("y", "h"))})
    kept = [*KEY, "height", "width", "filter_global_tissue_fraction", "effective_mpp_x", "effective_mpp_y"]
    labels = keep(rasters.segmented(rois, model, kept, p))
    good = labels.where("error is null").drop("error").withColumn("mpp", (F.col("effective_mpp_x") + F.col("effective_mpp_y")) / 2)
    features = keep(rasters.label_features(good, [*KEY, "filter_global_tissue_fraction", "effective_mpp_x", "effective_mpp_y"], p))
    scored = selection.with_raw_score(features.where("error is null").drop("error").withColumnRenamed("filter_global_tissue_fraction", "tissue_fraction"), p)
    absent = plan.select(*KEY).join(regions.select(*KEY), KEY, "left_anti").select("slide_id", F.format_string("no raster of region %d, %d", "grid_x", "grid_y").alias("error"))
    failed = screened.where("error is not null").select("slide_id", "error").distinct().unionByName(absent).unionByName(labels.where("error is not null").select("slide_id", "error")).unionByName(features.where("error is not null").select("slide_id", "error"))
    return Selection(screened, keep(selection.classified(scored, p, KEY)), labels, failed)


def score_rois(chosen: Selection, regions: DataFrame, model: Callable[[], Callable], keep: Callable[[DataFrame], DataFrame], p: Params = PARAMS) -> tuple[DataFrame, DataFrame]:
    """(scores of the selected regions with their rasters, failures). Label rasters are those of the selection."""
    picked = selection.ranked(chosen.decisions.where(F.col("final_decision").isin(*selection.CHOSEN)), "roi_score", "rank", "slide_id")
    rgb = regions.join(_sent(picked.select(*KEY)), KEY, "left_semi")
    objects = keep(rasters.segmented(rgb, model, [*KEY, "height", "width"], p, objects=True))
    labels = chosen.labels.where("error is null").join(_sent(picked.select(*KEY)), KEY, "left_semi").select(*KEY, "mask")
    good = objects.where("error is null").drop("error").withColumnRenamed("mask", "objects").join(labels, KEY)
    counted = keep(rasters.objects_in_class(good, [*KEY, "height", "width", "mask"], p))
    scored = scoring.with_object_score(counted.where("error is null").drop("error").join(picked, KEY), p)
    failed = objects.where("error is not null").select("slide_id", "error").unionByName(counted.where("error is not null").select("slide_id", "error"))
    return scored, failed


def summarize_slides(slides: DataFrame, chosen: Selection, scores: DataFrame, failed: DataFrame, p: Params = PARAMS) -> DataFrame:
    """One row for each slide, as it stands in the summary; a slide with any failure is FAILED."""
    passed = chosen.windows.groupBy("slide_id").agg(F.count_if(F.col("filter_reason") == "pass").alias("num_passing"), F.count("grid_x").alias("num_candidate_windows"))
    rows = scoring.with_status(slides.select("slide_id", "wsi_path"), passed, scoring.slide_scores(scores, p, "slide_id"), "slide_id")
    errors = failed.groupBy("slide_id").agg(F.min("error").alias("error_message"))
    bad = F.col("error_message").isNotNull()
    out = rows.join(errors, "slide_id", "left").withColumn("status", F.when(bad, "FAILED").otherwise(F.col("status")))
    zero = {c: F.when(bad, F.lit(0).cast(kind)).otherwise(F.col(c)) for c, kind in out.dtypes if c.startswith(("score_", "num_", "total_"))}
    return out.withColumns(zero | {"num_candidate_windows": F.when(F.col("status") == "OK", F.col("num_candidate_windows")), "reason": F.when(~bad, F.col("reason"))}).drop("num_passing")


def run_batch(slides: DataFrame, thumbnails: DataFrame, regions: DataFrame, old: DataFrame | None, label_model: Callable[[], Callable], object_model: Callable[[], Callable], keep: Callable[[DataFrame], DataFrame], p: Params = PARAMS) -> tuple[DataFrame, DataFrame]:
    """(summary of all slides, failed slides of this run): finished slides of an earlier summary are taken over, the others worked on.

    slides: wsi_path, slide_w0, slide_h0, mpp_x, mpp_y. The other tables have slide_id. Paths that share an id count once, the first of them.
    """
    all_slides = catalogue.with_resolution(catalogue.first_of_id(catalogue.with_ids(slides, p)), p)
    todo = all_slides if p.overwrite or old is None else summary.unfinished(all_slides, old)
    chosen = select_rois(todo, thumbnails, regions, label_model, keep, p)
    scores, late = score_rois(chosen, regions, object_model, keep, p)
    new = keep(summarize_slides(todo, chosen, scores, chosen.failed.unionByName(late), p))
    whole = new if old is None else summary.upserted(old, new)
    return whole, new.where("status = 'FAILED'")
