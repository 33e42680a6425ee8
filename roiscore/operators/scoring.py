"""Object scores of regions and slides; all built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roiscore.config import PARAMS, Params

EPS = 1e-7


def with_object_score(rois: DataFrame, p: Params = PARAMS) -> DataFrame:
    """The share of the class's area that its objects cover, by their number and a fixed diameter, capped."""
    out = rois.withColumns({"til_bbox_width_px": F.lit(p.object_diameter_um) / F.col("effective_mpp_x"), "til_bbox_height_px": F.lit(p.object_diameter_um) / F.col("effective_mpp_y")})
    out = out.withColumn("area_one_til_px", F.col("til_bbox_width_px") * F.col("til_bbox_height_px"))
    out = out.withColumn("estimated_all_tils_area_px", F.col("num_tils_inside_stroma") * F.col("area_one_til_px"))
    out = out.withColumn("roi_tils_score_raw_fraction", F.col("estimated_all_tils_area_px") / (F.col("stroma_area_px") + F.lit(EPS)))
    out = out.withColumn("roi_tils_score_fraction", F.least("roi_tils_score_raw_fraction", F.lit(p.max_score)))
    return out.withColumns({"roi_tils_score_percent": F.col("roi_tils_score_fraction") * 100.0, "roi_tils_score_was_capped": F.col("roi_tils_score_raw_fraction") > p.max_score})


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def slide_scores(rois: DataFrame, p: Params = PARAMS, slide: str = "slide_key") -> DataFrame:
    """Counts, sums, and the mean, area-weighted mean and median of each slide's region scores.

    A missing score counts as 0 in all three; scores are clipped; without any positive weight the weighted mean is the plain one.
    """
    score = F.least(F.greatest(F.coalesce(F.nanvl("roi_tils_score_fraction", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(p.max_score))
    weight = F.coalesce(F.nanvl(F.col("stroma_area_px").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rois.withColumns({"_x": score, "_w": weight})
    heavy = _finite(F.col("_w")) & (F.col("_w") > 0)
    mean = F.coalesce(F.avg("_x"), F.lit(0.0))
    weighted = F.coalesce(F.sum(F.when(heavy, F.col("_x") * F.col("_w"))) / F.nullif(F.sum(F.when(heavy, F.col("_w"))), F.lit(0.0)), mean)
    out = rows.groupBy(slide).agg(
        F.count("*").alias("num_selected_rois"),
        F.count_if(F.col("final_decision") == "direct_accept").alias("num_direct_selected_rois"),
        F.count_if(F.col("final_decision") == "neighbor_associated_stroma").alias("num_neighbor_selected_rois"),
        F.sum("stroma_area_px").alias("total_selected_stroma_area_px"),
        F.sum("num_tils_inside_stroma").alias("total_tils_inside_stroma_count"),
        mean.alias("score_mean_fraction"),
        weighted.alias("score_stroma_weighted_mean_fraction"),
        F.coalesce(F.median("_x"), F.lit(0.0)).alias("score_median_fraction"),
    )
    return out.withColumns({f"score_{k}_percent": F.col(f"score_{k}_fraction") * 100.0 for k in ("mean", "stroma_weighted_mean", "median")})


def with_status(slides: DataFrame, passed: DataFrame, scores: DataFrame, slide: str = "slide_key") -> DataFrame:
    """One row a slide: its status by how many regions passed and were selected, and zero scores where there are none.

    passed: (slide, num_passing). The slides without regions keep their row.
    """
    out = slides.join(passed, slide, "left").join(scores, slide, "left")
    none, unselected = F.coalesce("num_passing", F.lit(0)) == 0, F.coalesce("num_selected_rois", F.lit(0)) == 0
    status = F.when(none, "NO_TISSUE_ROIS").when(unselected, "NO_SELECTED_ROIS").otherwise("OK")
    reason = F.when(none, "no region passed the foreground filter").when(unselected, "no region was selected")
    zeros = {c: F.coalesce(c, F.lit(0).cast(kind)) for c, kind in scores.dtypes if c != slide}
    return out.withColumns({"status": status, "reason": reason, **zeros})
