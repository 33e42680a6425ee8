"""Raster rows from plain image files, and at the resolution that the models expect."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roiscore.config import PARAMS, Params
from roiscore.operators.rasters import each_raster, resized


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, rgb, error) of the images in a folder; a fourth channel is dropped, grey is repeated. A file that Spark's reader can't decode has an error and no raster."""
    images = spark.read.format("image").option("dropInvalid", False).load(folder)
    rows = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))

    def work(row) -> dict:
        if row["height"] < 1:
            raise ValueError("not an image that can be decoded")
        px = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
        rgb = np.repeat(px, 3, axis=2) if row["channels"] == 1 else px[..., 2::-1]
        return {"rgb": np.ascontiguousarray(rgb).tobytes()}

    return each_raster(rows, work, "rgb binary", ["path", "height", "width"])


def at_roi_size(regions: DataFrame, keep: list[str], p: Params = PARAMS) -> DataFrame:
    """Regions resized (bilinear) to the size that the models expect; those of that size stay as they are."""
    size = F.lit(p.roi_px)
    return resized(regions, p.roi_px, p.roi_px, keep).withColumns({"height": size, "width": size})
