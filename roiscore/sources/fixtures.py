"""Tables of the jobs' shapes, derived from general test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roiscore.operators.rasters import from_pixels
from roiscore.operators.summary import latest
from roiscore.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of slides, some without resolution, with upper-case or foreign suffixes, or smaller than one window."""
    k = F.col("s_suppkey").cast("long")
    ext = F.element_at(F.array(*map(F.lit, (".svs", ".TIF", ".tiff", ".ndpi", ".mrxs", ".txt"))), (k % 6 + 1).cast("int"))
    path = F.concat(F.lit("/wsi/lab"), (k % 3).cast("string"), F.lit("/"), F.when(k % 7 == 0, "S:").otherwise("S"), F.lpad(k.cast("string"), 6, "0"), ext)
    pick = lambda *v: F.element_at(F.array(*(F.lit(x).cast("double") for x in v)), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("slide_key"),
        path.alias("wsi_path"),
        (1500 + (k * 7919) % 30000).alias("slide_w0"),
        (1200 + (k * 104729) % 24000).alias("slide_h0"),
        pick(None, 0.2527, 0.5, 0.22, 0.25).alias("mpp_x"),
        F.when(k % 10 == 3, F.lit(None).cast("double")).otherwise(pick(0.25, 0.2527, 0.5, 0.23, 0.25)).alias("mpp_y"),
        F.when(k % 2 == 0, F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0001), F.lit(4.0003))).alias("level_downsamples"),
    )


SLIDES = """
    select cast(s_suppkey as bigint) as slide_key,
        '/wsi/lab' || (s_suppkey % 3) || '/' || (case when s_suppkey % 7 = 0 then 'S:' else 'S' end) || lpad(cast(s_suppkey as varchar), 6, '0')
            || (case s_suppkey % 6 when 0 then '.svs' when 1 then '.TIF' when 2 then '.tiff' when 3 then '.ndpi' when 4 then '.mrxs' else '.txt' end) as wsi_path,
        cast(1500 + (s_suppkey * 7919) % 30000 as bigint) as slide_w0, cast(1200 + (s_suppkey * 104729) % 24000 as bigint) as slide_h0,
        case s_suppkey % 5 when 0 then null when 1 then 0.2527e0 when 2 then 0.5e0 when 3 then 0.22e0 else 0.25e0 end as mpp_x,
        case when s_suppkey % 10 = 3 then null else case s_suppkey % 5 when 0 then 0.25e0 when 1 then 0.2527e0 when 2 then 0.5e0 when 3 then 0.23e0 else 0.25e0 end end as mpp_y,
        case when s_suppkey % 2 = 0 then [1.0e0, 4.0e0, 16.0e0] else [1.0e0, 2.0001e0, 4.0003e0] end as level_downsamples
    from supplier"""


def roi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of regions of the first ninety slides on grids of twelve columns, with all outcomes of the selection."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(o.cast("long").alias("o_orderkey")).withColumn("slide_key", o % 90)
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("slide_key").orderBy("o_orderkey")).cast("long") - 1)
    low = (F.col("slide_key") % 10 == 0) | (F.col("rn") % 3 == 0)
    return rows.select(
        "slide_key",
        (F.col("rn") % 12).alias("grid_x"),
        F.floor(F.col("rn") / 12).alias("grid_y"),
        "o_orderkey",
        ((500 + (o * 37) % 501) / 1000).alias("tissue_fraction"),
        F.when(low, ((o * 13) % 12) / 1000).otherwise(((o * 7919) % 400) / 1000).alias("tumor_fraction"),
        ((100 + (o * 31) % 501) / 1000).alias("stroma_fraction"),
        F.when(low, ((o * 17) % 6) / 10000).otherwise(((o * 17) % 200) / 10000).alias("interface_density"),
        ((700 + (o * 101) % 301) / 1000).alias("peritumoral_stroma_fraction"),
    )


ROI_FEATURES = """
    select slide_key, rn % 12 as grid_x, rn // 12 as grid_y, o_orderkey,
        (500 + (o_orderkey * 37) % 501) / 1000e0 as tissue_fraction,
        case when slide_key % 10 = 0 or rn % 3 = 0 then ((o_orderkey * 13) % 12) / 1000e0 else ((o_orderkey * 7919) % 400) / 1000e0 end as tumor_fraction,
        (100 + (o_orderkey * 31) % 501) / 1000e0 as stroma_fraction,
        case when slide_key % 10 = 0 or rn % 3 = 0 then ((o_orderkey * 17) % 6) / 10000e0 else ((o_orderkey * 17) % 200) / 10000e0 end as interface_density,
        (700 + (o_orderkey * 101) % 301) / 1000e0 as peritumoral_stroma_fraction
    from (select cast(o_orderkey as bigint) as o_orderkey, cast(o_orderkey % 90 as bigint) as slide_key,
                 row_number() over (partition by o_orderkey % 90 order by o_orderkey) - 1 as rn from orders)"""


def roi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and object counts of the same regions, some of them 0, and some scores missing."""
    o = F.col("o_orderkey").cast("long")
    zero = o % 97 == 0
    return table(spark, sf_dir, "orders").select(
        o.alias("o_orderkey"),
        F.when(zero, 0).otherwise((o * 6151) % 4194304).cast("long").alias("stroma_area_px"),
        F.when(zero, 0).otherwise((o * 53) % 900).cast("long").alias("num_tils_inside_stroma"),
        (F.lit(0.25) * (1 + (o % 3) / 100)).alias("effective_mpp_x"),
        (F.lit(0.25) * (1 + (o % 3) / 100)).alias("effective_mpp_y"),
        (o % 41 == 0).alias("score_missing"),
    )


ROI_COUNTS = """
    select cast(o_orderkey as bigint) as o_orderkey,
        cast(case when o_orderkey % 97 = 0 then 0 else (o_orderkey * 6151) % 4194304 end as bigint) as stroma_area_px,
        cast(case when o_orderkey % 97 = 0 then 0 else (o_orderkey * 53) % 900 end as bigint) as num_tils_inside_stroma,
        0.25e0 * (1 + (o_orderkey % 3) / 100e0) as effective_mpp_x, 0.25e0 * (1 + (o_orderkey % 3) / 100e0) as effective_mpp_y,
        o_orderkey % 41 = 0 as score_missing
    from orders"""


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of stages by slide, in hundredths of a second as decimals, so that sums are exact."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("slide_id"), F.col("event_type").alias("stage"), F.round(F.col("value") * 100, 2).cast("decimal(18,2)").alias("seconds"))


STAGE_TIMES = """
    select 'S' || user_id as slide_id, event_type as stage, cast(round(value * 100, 2) as decimal(18, 2)) as seconds from events"""


def summary_rows(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Summary rows of an earlier run (one a slide), or of this one (several a slide, with a column of errors); the events' time tells them apart."""
    e = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    rows = e.where(F.col("ts") >= cut) if new else e.where(F.col("ts") < cut)
    failed = F.col("event_type") == "error"
    rows = rows.select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("slide_id"), F.when(failed, "FAILED").otherwise("OK").alias("status"), F.col("value").alias("score_mean_percent"), "ts", "event_id", *([F.when(failed, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error_message")] if new else []))
    return rows if new else latest(rows, ["ts", "event_id"])


OLD_ROWS = """
    select * exclude (n) from (
        select 'S' || user_id as slide_id, case when event_type = 'error' then 'FAILED' else 'OK' end as status, value as score_mean_percent, ts, event_id,
            row_number() over (partition by user_id order by ts desc, event_id desc) as n
        from events where ts < timestamp '2024-01-20') where n = 1"""
NEW_ROWS = """
    select 'S' || user_id as slide_id, case when event_type = 'error' then 'FAILED' else 'OK' end as status, value as score_mean_percent, ts, event_id,
        case when event_type = 'error' then 'event ' || event_id end as error_message
    from events where ts >= timestamp '2024-01-20'"""


def label_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters of three classes (0, 1, 2) and of objects; every fiftieth has no class 1."""
    e = spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").cast("long").alias("roi_id"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(64))).alias("i"))
    v, other = F.element_at("embedding", F.col("i")), F.element_at("embedding", (F.col("i") + 30) % 64 + 1)
    cls = F.when(v > 0.0557, F.when(F.col("roi_id") % 50 == 0, 2).otherwise(1)).when(v < -0.0555, 0).otherwise(2)
    return e.select("roi_id", F.floor((F.col("i") - 1) / 8).alias("y"), ((F.col("i") - 1) % 8).cast("long").alias("x"), cls.alias("cls"), (other > 0.02).cast("int").alias("obj"))


LABEL_PX = """
    select cast(vec_id as bigint) as roi_id, cast((i - 1) // 8 as bigint) as y, cast((i - 1) % 8 as bigint) as x,
        case when embedding[i] > 0.0557e0 then case when vec_id % 50 = 0 then 2 else 1 end when embedding[i] < -0.0555e0 then 0 else 2 end as cls,
        case when embedding[(i + 30) % 64 + 1] > 0.02e0 then 1 else 0 end as obj
    from embeddings, range(1, 65) t(i)"""


def thumb_px(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """64 x 48 thumbnails with one coloured blob each; the supplier's columns `carry` go along."""
    s = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").cast("long").alias("k"), *carry).select("k", *carry, (16 + (F.col("k") * 7) % 24).alias("cx"), (14 + (F.col("k") * 5) % 16).alias("cy"), (12 + (F.col("k") * 3) % 14).alias("rad"))
    grid = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long"))).alias("y")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("x"))
    d = grid.selectExpr("k", *carry, "x", "y", "rad * rad as r2", "(x - cx) * (x - cx) + (y - cy) * (y - cy) as d2", "(x * 31 + y * 17 + k * 13) % 23 as n")
    return d.selectExpr("k as slide_key", "y", "x", "case when d2 < r2 then 170 + n else 225 + n end as r", "case when d2 < r2 then 60 + (90 * d2) div r2 + n else 222 + n end as g", "case when d2 < r2 then 140 + n else 228 + n % 20 end as b", *carry)


THUMB_PX = """
    select k as slide_key, y, x, case when d2 < r2 then 170 + n else 225 + n end as r,
        case when d2 < r2 then 60 + (90 * d2) // r2 + n else 222 + n end as g, case when d2 < r2 then 140 + n else 228 + n % 20 end as b
    from (select k, x, y, rad * rad as r2, (x - cx) * (x - cx) + (y - cy) * (y - cy) as d2, (x * 31 + y * 17 + k * 13) % 23 as n
          from (select cast(s_suppkey as bigint) as k, 16 + (s_suppkey * 7) % 24 as cx, 14 + (s_suppkey * 5) % 16 as cy, 12 + (s_suppkey * 3) % 14 as rad from supplier), range(64) tx(x), range(48) ty(y))"""


def tile_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of three classes from nine overlapping 8 x 8 tiles (step 6) for each 20 x 20 raster; the last raster may have fewer."""
    e = spread(table(spark, sf_dir, "embeddings"))
    e = e.select(F.col("vec_id").cast("long").alias("v"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(64))).alias("i"))
    z = lambda step: F.least(F.greatest(F.rint((F.element_at("embedding", (F.col("i") + step) % 64 + 1 if step else F.col("i")).cast("double") + 0.5) * 1024), F.lit(0.0)), F.lit(1024.0)) / 1024.0
    return e.select(F.floor(F.col("v") / 9).alias("roi_id"), (F.col("v") % 9).alias("tile"), (F.floor((F.col("v") % 9) / 3) * 6 + F.floor((F.col("i") - 1) / 8)).alias("y"), ((F.col("v") % 9) % 3 * 6 + (F.col("i") - 1) % 8).alias("x"), F.array(z(0), z(20), z(41)).alias("p"))


TILE_PROBS = """
    select cast(vec_id // 9 as bigint) as roi_id, vec_id % 9 as tile, cast(((vec_id % 9) // 3) * 6 + (i - 1) // 8 as bigint) as y, cast(((vec_id % 9) % 3) * 6 + (i - 1) % 8 as bigint) as x,
        list_transform([embedding[i], embedding[(i + 20) % 64 + 1], embedding[(i + 41) % 64 + 1]],
            lambda z: least(greatest(round_even((cast(z as double) + 0.5e0) * 1024, 0), 0), 1024) / 1024.0e0) as p
    from embeddings, range(1, 65) t(i)"""


def eval_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth (one class a pixel) and predicted probabilities, by sample, pixel and class."""
    e = spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").cast("long").alias("sample_id"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(64))).alias("i"))
    v = F.element_at("embedding", F.col("i"))
    cls = F.when(v > 0.0557, 1).when(v < -0.0555, 0).otherwise(2)
    z = lambda step: F.least(F.greatest(F.rint((F.element_at("embedding", (F.col("i") + step) % 64 + 1 if step else F.col("i")).cast("double") + 0.5) * 1024), F.lit(1.0)), F.lit(1024.0)) / 1024.0
    rows = e.select("sample_id", F.floor((F.col("i") - 1) / 8).alias("y"), ((F.col("i") - 1) % 8).cast("long").alias("x"), cls.alias("cls"), F.array(z(0), z(20), z(41)).alias("p"))
    total = F.element_at("p", 1) + F.element_at("p", 2) + F.element_at("p", 3)
    return rows.select("sample_id", "y", "x", "cls", total.alias("total"), F.posexplode("p").alias("class", "q")).select("sample_id", "y", "x", "class", (F.col("cls") == F.col("class")).cast("double").alias("y_true"), (F.col("q") / F.col("total")).alias("y_pred"))


EVAL_PX = """
    select sample_id, y, x, c as class, case when cls = c then 1e0 else 0e0 end as y_true, p[c + 1] / (p[1] + p[2] + p[3]) as y_pred
    from (select cast(vec_id as bigint) as sample_id, (i - 1) // 8 as y, (i - 1) % 8 as x, case when embedding[i] > 0.0557e0 then 1 when embedding[i] < -0.0555e0 then 0 else 2 end as cls,
            list_transform([embedding[i], embedding[(i + 20) % 64 + 1], embedding[(i + 41) % 64 + 1]],
                lambda z: least(greatest(round_even((cast(z as double) + 0.5e0) * 1024, 0), 1), 1024) / 1024.0e0) as p
          from embeddings, range(1, 65) t(i)), range(3) u(c)"""


def batch_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Slides, thumbnails, regions and an earlier summary of one batch. Slides are as large as their thumbnails, which are cut into regions of 16 x 16.

    Suppliers with a negative balance have no thumbnail, those of nation 3 lack one region, those with a balance of 9000 or more are finished.
    """
    key = F.concat(F.lit("S"), F.lpad(F.col("slide_key").cast("string"), 6, "0"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("slide_key"), "s_acctbal", "s_nationkey").withColumn("slide_id", key)
    slides = suppliers.select(F.concat(F.lit("/batch/"), "slide_id", F.lit(".svs")).alias("wsi_path"), F.lit(64).cast("long").alias("slide_w0"), F.lit(48).cast("long").alias("slide_h0"), F.lit(0.25).alias("mpp_x"), F.lit(0.25).alias("mpp_y"))
    px = thumb_px(spark, sf_dir, ("s_acctbal", "s_nationkey")).withColumn("slide_id", key)
    thumbs = from_pixels(px.where("s_acctbal >= 0"), ["slide_id"], {"rgb": ["r", "g", "b"]})
    tiles = px.selectExpr("slide_id", "s_nationkey", "x div 16 as grid_x", "y div 16 as grid_y", "x % 16 as x", "y % 16 as y", "r", "g", "b").where("s_nationkey <> 3 or grid_x <> 1 or grid_y <> 1")
    regions = from_pixels(tiles, ["slide_id", "grid_x", "grid_y"], {"rgb": ["r", "g", "b"]})
    old = suppliers.where("s_acctbal >= 9000").select("slide_id", F.lit("OK").alias("status"), F.lit(1.5).alias("score_mean_percent"))
    return slides, thumbs, regions, old


BATCH_SLIDES = """
    select cast(s_suppkey as bigint) as slide_key, 'S' || lpad(cast(s_suppkey as varchar), 6, '0') as slide_id, s_acctbal, s_nationkey from supplier"""
