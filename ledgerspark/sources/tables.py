"""Tables in a folder of Parquet files or of Parquet directories, one per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt over all tasks by their first column, a key. A table's file may be one task's to read, so narrow columns are dealt before long texts are made of them."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), rows.columns[0])
