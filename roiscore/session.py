"""Making the package importable where its functions run."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

_ROOT = Path(__file__).resolve().parent


#: Arrow batches between Spark and its Python workers, for which Spark's own default is 64 MB. Spark's default is lowered,
#: as every worker and task holds several of them; a size that the session has chosen stays.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2097152b"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_KEY, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each Spark context; they need no folder in common with the driver. Arrow batches are made small."""
    small_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_roiscore_shipped", False) or not _ROOT.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="roiscore-")) / "roiscore.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(_ROOT.rglob("*.py")):
            z.write(source, Path(_ROOT.name) / source.relative_to(_ROOT))
    context.addPyFile(str(archive))
    context._roiscore_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where its files give fewer partitions than there are, as one large row group does: work on its rows outweighs moving so few. A table of many partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; in local mode a local one where it names none."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roiscore-shared-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks that list the folders below a path, for which Spark's own default is one a folder, up to 10,000.
LISTING_KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def load_folders(spark: SparkSession, reader: DataFrameReader, path: str) -> DataFrame:
    """reader.load(path), where path holds very many small folders: some tasks a core list them, whose number the session gets back."""
    before = spark.conf.get(LISTING_KEY)
    spark.conf.set(LISTING_KEY, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        return reader.load(path)
    finally:
        spark.conf.set(LISTING_KEY, before)
