"""Small tables over all cores."""

from pyspark.sql import functions as F

from roiscore.session import spread


def test_tables_of_few_partitions_are_dealt_out_and_others_stay(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df).agg(F.sum("id")).first()[0] == 499500
    many = spark.range(0, 1000, 1, 50)
    assert spread(many) is many
