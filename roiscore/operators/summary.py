"""Bookkeeping of a restartable batch: what is left to do, upserts, failures, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roiscore.functions.text import duration

TOTAL = "total_pipeline_time"


def unfinished(slides: DataFrame, summary: DataFrame, key: str = "slide_id") -> DataFrame:
    """Slides without a finished row in the summary; failed ones are tried again."""
    return slides.join(summary.where("status <> 'FAILED'").select(key), key, "left_anti")


def finished(slides: DataFrame, summary: DataFrame, key: str = "slide_id") -> DataFrame:
    """The summary's rows of slides that need no work."""
    return summary.where("status <> 'FAILED'").join(slides.select(key), key, "left_semi")


def latest(rows: DataFrame, order: list[str], key: str = "slide_id") -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, order: list[str] | None = None, key: str = "slide_id") -> DataFrame:
    """old without the keys of new, and new (its latest rows, given an order); keys compare as text, missing columns are null."""
    if order:
        new = latest(new, order, key)
    keys = new.select(F.col(key).cast("string").alias("_key"))
    kept = old.join(keys, old[key].cast("string") == F.col("_key"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def failures(rows: DataFrame) -> DataFrame:
    """Failed rows as they stand in summaries: zero scores."""
    zero = {c: F.lit(0.0) for c in ("score_mean_percent", "score_stroma_weighted_mean_percent", "score_median_percent")}
    return rows.where("status = 'FAILED'").withColumns(zero)


def batch_summary(skipped: DataFrame, processed: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of all slides of a batch, whatever columns they have."""
    return skipped.unionByName(processed, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)


def stage_totals(times: DataFrame, key: str = "slide_id") -> DataFrame:
    """Seconds of each slide and stage, and each slide's total, also as text."""
    sums = times.groupingSets([[key, "stage"], [key]], key, "stage").agg(F.sum("seconds").alias("seconds"), F.grouping_id().alias("_set"))
    stage = F.when(F.col("_set") == 0, F.col("stage")).otherwise(F.lit(TOTAL))
    return sums.select(key, stage.alias("stage"), "seconds").withColumn("formatted", duration(F.col("seconds").cast("double")))


def timing_lines(totals: DataFrame, key: str = "slide_id") -> DataFrame:
    """The totals as lines of text."""
    return totals.select(key, F.format_string("%-60s %s", "stage", "formatted").alias("value"))


def batch_report(times: DataFrame, key: str = "slide_id") -> DataFrame:
    """One row: slides, seconds, and these as text."""
    total = times.agg(F.countDistinct(key).alias("num_slides"), F.sum("seconds").alias("batch_seconds"))
    return total.withColumn("formatted", duration(F.col("batch_seconds").cast("double")))
