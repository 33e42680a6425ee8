"""Scores and decisions of regions, the grid-neighbour rule, and ranks; all built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roiscore.config import PARAMS, Params

CHOSEN = ("direct_accept", "neighbor_associated_stroma")
KEY = ["slide_key", "grid_x", "grid_y"]


def with_raw_score(features: DataFrame, p: Params = PARAMS) -> DataFrame:
    """tumor_stroma_balance, and roi_score between 0 and 1."""
    out = features.withColumn("tumor_stroma_balance", F.lit(2.0) * F.least("tumor_fraction", "stroma_fraction"))
    near = F.least(F.col("interface_density") / F.lit(p.interface_scale), F.lit(1.0))
    score = (
        F.lit(p.weight_peritumoral) * F.col("peritumoral_stroma_fraction")
        + F.lit(p.weight_stroma) * F.col("stroma_fraction")
        + F.lit(p.weight_interface) * near
        + F.lit(p.weight_tissue) * F.col("tissue_fraction")
        + F.lit(p.weight_balance) * F.col("tumor_stroma_balance")
    )
    return out.withColumn("roi_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def initial_decision(p: Params = PARAMS) -> Column:
    c = F.col
    enough = c("tissue_fraction") >= p.min_tissue
    direct = enough & (c("stroma_fraction") >= p.direct_min_stroma) & (c("tumor_fraction") >= p.direct_min_tumor) & (c("interface_density") >= p.direct_min_interface) & (c("roi_score") >= p.direct_score)
    waiting = enough & (c("stroma_fraction") >= p.waiting_min_stroma) & (c("tumor_fraction") < p.waiting_max_tumor) & (c("roi_score") >= p.waiting_score)
    return F.when(direct, "direct_accept").when(waiting, "stroma_waiting_for_neighbor").otherwise("discard")


def classified(scored: DataFrame, p: Params = PARAMS, key: list[str] = KEY) -> DataFrame:
    """initial_decision and final_decision, and the best of the neighbours that a waiting region has.

    Each waiting region goes to the keys of its eight neighbours, so the join is an equi-join on the grid; one pass, as
    neighbours count by their features, whatever their own decision.
    """
    *whose, gx, gy = key
    decided = scored.withColumn("initial_decision", initial_decision(p))
    around = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    asking = decided.where("initial_decision = 'stroma_waiting_for_neighbor'").select(*key, F.explode(F.array(*around)).alias("d"))
    asking = asking.select(*key, *(F.col(k).alias(f"_{k}") for k in whose), (F.col(gx) + F.col("d.dx")).alias(f"_{gx}"), (F.col(gy) + F.col("d.dy")).alias(f"_{gy}"))
    near = scored.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("tumor_fraction").alias("_t"), F.col("interface_density").alias("_i"))
    support = asking.join(near, [f"_{k}" for k in key]).groupBy(*key).agg(
        F.max("_t").alias("_best_t"),
        F.max("_i").alias("_best_i"),
        F.bool_or((F.col("_t") >= p.neighbor_min_tumor) | (F.col("_i") >= p.neighbor_min_interface)).alias("_supported"),
    )
    out = decided.join(support, key, "left")
    final = F.when(F.col("initial_decision") == "direct_accept", "direct_accept").when(F.coalesce("_supported", F.lit(False)), "neighbor_associated_stroma").otherwise("discard")
    best = {"best_neighbor_tumor_fraction": F.greatest(F.coalesce("_best_t", F.lit(0.0)), F.lit(0.0)), "best_neighbor_interface_density": F.greatest(F.coalesce("_best_i", F.lit(0.0)), F.lit(0.0))}
    return out.withColumns({"final_decision": final, **best}).drop("_best_t", "_best_i", "_supported")


def ranked(df: DataFrame, by: str, name: str, slide: str = "slide_key") -> DataFrame:
    """The rank within each slide by a score from the largest; ties go by row and column of the grid."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(slide).orderBy(F.desc(by), "grid_y", "grid_x")))


def selected(decided: DataFrame) -> DataFrame:
    """The chosen regions with their rank."""
    return ranked(decided.where(F.col("final_decision").isin(*CHOSEN)), "roi_score", "rank")
