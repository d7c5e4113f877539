"""Stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a stored table for each core below which its rows are dealt anew.
CORE_BYTES = 4 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One of a few megabytes for each core is often a single row group, which a single task would read
    and work on; its rows are dealt to all cores first. The shuffle is no larger than CORE_BYTES a core; larger tables
    have many row groups and are read where they are."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # a number, or an object that prints as one
    return df.repartition(cores) if size <= cores * CORE_BYTES else df
