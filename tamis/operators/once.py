"""Columns that are worked out once for each row, whoever reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with `columns`, which must have new names.

    They leave a generator over one struct, and the optimiser merges no projection through a generator: what is built on
    these columns reads them as values, where a plain projection would write their expressions out again wherever they
    are used, until the plan of a few such steps no longer fits the driver. There is a row for each row, no shuffle, and
    streams work alike.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
