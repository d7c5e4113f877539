"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`; a temporary one only where that is absent, as in
    tests on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tamis-checkpoint-"))
    return context.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint, so a lost executor never recomputes what stands before it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until no column of `df` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def uniform(*columns, seed: int = 7):
    """A number in [0, 1) that depends on the values of `columns` alone: the same row draws the same number anywhere."""
    bits = F.xxhash64(*columns, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
    return bits / F.lit(float(1 << 52))


def labelled_sample(rows: DataFrame, label: str, per_label: int, *identity: str) -> DataFrame:
    """About `per_label` rows of each value of `label`, drawn by a hash of `identity`; rows of a rarer label all stay.

    The counts behind the rates cover all rows. The expected size is at most `per_label` times the number of labels.
    """
    rates = rows.groupBy(label).agg(F.count("*").alias("_n"))
    rates = {r[label]: min(1.0, per_label / r["_n"]) for r in rates.collect()}
    if not rates:
        return rows.limit(0)
    rate = F.lit(0.0)
    for value, share in rates.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(share)).otherwise(rate)
    return rows.where(uniform(*identity) < rate)
