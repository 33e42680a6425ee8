"""Operators on tables with one row a pixel; all built in. The forms on whole rasters are in rasters.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pixel rows that a task sorts at a time, about.
TASK_PIXELS = 1 << 20
#: The colours of the classes 1 and 2, and of objects.
TUMOR_RGB, STROMA_RGB, OBJECT_RGB = (255, 0, 0), (0, 255, 0), (255, 255, 0)


def saturation_value(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """8-bit saturation and value, in fixed point."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    scale = F.when(high > 0, F.rint(F.lit(1044480.0) / high).cast("long")).otherwise(0)
    return F.shiftright((high - low) * scale + 2048, 12).cast("int"), high.cast("int")


def saturation_histogram(px: DataFrame, slide: str = "slide_key") -> DataFrame:
    return px.groupBy(slide, "s").agg(F.count("*").alias("n"))


def otsu_thresholds(histogram: DataFrame, slide: str = "slide_key") -> DataFrame:
    """The split of the greatest variance between classes for each slide (the first of equals), and the threshold that the mask uses.

    At most 256 rows a slide are sorted; sums are integers, so only the last division rounds.
    """
    run = Window.partitionBy(slide).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(slide)
    h = histogram.withColumn("ns", F.col("n") * F.col("s"))
    h = h.withColumns({"q": F.sum("n").over(run), "m": F.sum("ns").over(run), "all_n": F.sum("n").over(whole), "all_m": F.sum("ns").over(whole)})
    off = (F.col("all_m") * F.col("q") - F.col("all_n") * F.col("m")).cast("double")
    between = F.when(F.col("q") < F.col("all_n"), off * off / (F.col("q") * (F.col("all_n") - F.col("q")))).otherwise(0.0)
    best = h.withColumn("between", between).groupBy(slide).agg(F.max_by("s", F.struct("between", -F.col("s"))).alias("otsu"))
    return best.withColumn("threshold", F.greatest(F.lit(20), (F.lit(0.8) * F.col("otsu")).cast("int")))


def with_thresholds(px: DataFrame, slide: str = "slide_key") -> DataFrame:
    """Pixel rows (s) with their slide's threshold.

    The join is a shuffle by slide that hashes the thresholds, one row a slide: Spark takes pixel rows that are made of few rows for as few
    and would broadcast them.
    """
    limit = otsu_thresholds(saturation_histogram(px, slide), slide).select(slide, "threshold")
    return px.join(limit.hint("shuffle_hash"), slide)


def is_tissue(s: Column, v: Column, threshold: Column) -> Column:
    return (s > threshold) & (v < 245)


def by_raster(px: DataFrame, key: list[str]) -> DataFrame:
    """px dealt out by raster, in as many partitions as let a task have about TASK_PIXELS of them (a larger raster is in one); they are counted. The frames of `sliding` are found where rows are then, without another shuffle."""
    spark = px.sparkSession
    return px.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-px.count() // TASK_PIXELS)), *key)


def sliding(px: DataFrame, value: str, key: list[str], k: int, least: bool = True, outside: int | None = None, lines: tuple[str, str] = ("y", "x")) -> DataFrame:
    """px with the extreme of `value` over the k x k square around each pixel of a dense grid, as frames of rows and then of columns.

    What lies outside of the grid counts as `outside`, or is left out without it. An even square reaches one further up and left for the least,
    and down and right for the greatest, as erosion and dilation do. `lines` says whose frames come first; the result is the same. A task holds the rows of one line.
    """
    before, after = (k // 2, k - 1 - k // 2) if least else (k - 1 - k // 2, k // 2)
    for line, along in (lines, lines[::-1]):
        frame = Window.partitionBy(*key, line).orderBy(along).rowsBetween(-before, after)
        found = (F.min if least else F.max)(value).over(frame)
        if outside is not None:
            beyond = F.count(F.lit(1)).over(frame) < k
            found = F.when(beyond, (F.least if least else F.greatest)(found, F.lit(outside))).otherwise(found)
        px = px.withColumn(value, found)
    return px


def opened_closed(px: DataFrame, value: str, key: list[str], k: int) -> DataFrame:
    """An opening and then a closing of a 0/1 value by a k x k square. Each step begins with the lines that the one before ended with, as rows lie in their order."""
    for n, least in enumerate((True, False, False, True)):
        px = sliding(px, value, key, k, least, lines=("x", "y") if n % 2 else ("y", "x"))
    return px


def class_fractions(px: DataFrame, key: str = "roi_id") -> DataFrame:
    """Pixels and fractions of the classes 0, 1, 2 by raster."""
    counts = {"background": 0, "tumor": 1, "stroma": 2}
    out = px.groupBy(key).agg(F.count("*").alias("total_pixels"), *(F.count_if(F.col("cls") == v).alias(f"{k}_pixels") for k, v in counts.items()))
    return out.withColumns({f"{k}_fraction": F.col(f"{k}_pixels") / (F.col("total_pixels") + F.lit(1e-7)) for k in counts})


def merged_tiles(tiles: DataFrame) -> DataFrame:
    """The largest probability of each class over the tiles that cover a pixel."""
    p = [F.max(F.element_at("p", k + 1)).alias(f"p{k}") for k in range(3)]
    return tiles.groupBy("roi_id", "y", "x").agg(*p)


def best_class() -> Column:
    """The class of the largest probability, the lowest of equals."""
    return F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)


def foreground(p: Column) -> Column:
    """The foreground's probability: the only channel, or the second."""
    return F.when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(F.get(p, F.lit(1)))


def inside_class(labels: DataFrame, objects: DataFrame, cls: int = 2) -> DataFrame:
    """Object pixels on pixels of a class: a semi-join on the pixel's key."""
    return objects.where("obj = 1").join(labels.where(F.col("cls") == cls), ["roi_id", "y", "x"], "left_semi")


def class_color(cls: Column) -> Column:
    """The colour of a class as an array of three."""
    rgb = lambda c: F.array(*map(F.lit, c))
    return F.when(cls == 1, rgb(TUMOR_RGB)).when(cls == 2, rgb(STROMA_RGB)).otherwise(rgb((0, 0, 0)))


def blended(value: Column, color: Column, alpha: float) -> Column:
    """A weighted sum at every pixel, also where the colour is black."""
    return F.least(F.greatest(F.rint(value * F.lit(1.0 - alpha) + color * F.lit(alpha)), F.lit(0.0)), F.lit(255.0)).cast("int")


def dice_loss(px: DataFrame) -> DataFrame:
    """One minus the mean, over samples and classes, of the smoothed overlap of truth and prediction."""
    smooth = F.lit(1e-6)
    per = px.groupBy("sample_id", "class").agg(F.sum(F.col("y_true") * F.col("y_pred")).alias("both"), F.sum(F.col("y_true") + F.col("y_pred")).alias("either"))
    return per.agg((1.0 - F.avg((2.0 * F.col("both") + smooth) / (F.col("either") + smooth))).alias("dice_loss"))


def cross_entropy(px: DataFrame) -> DataFrame:
    """The mean over pixels; probabilities are normalised by pixel and clipped."""
    pixel = Window.partitionBy("sample_id", "y", "x")
    p = px.withColumn("p", F.least(F.greatest(F.col("y_pred") / F.sum("y_pred").over(pixel), F.lit(1e-7)), F.lit(1.0 - 1e-7)))
    return p.where("y_true > 0").agg((F.sum(-F.col("y_true") * F.log("p")) / F.sum("y_true")).alias("cross_entropy"))
