"""Word lists of any length: as a broadcast set of a checked size, or as a table that texts are joined with."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A list of more words is no literal of the plan any more but a set that is sent to the executors once.
LITERAL_WORDS = 512
#: Bytes of the words of such a set at most; a longer list has to be a table.
SET_BYTES = 64 << 20


def evidence_table(given_names: DataFrame, surnames: DataFrame, common_words: DataFrame) -> DataFrame:
    """(word) of what tables (word) of names have, without the common words. Nulls go, each word is there once."""
    words = lambda df: df.select(F.lower(F.trim("word")).alias("word")).where("word <> ''")
    return words(given_names).union(words(surnames)).distinct().join(words(common_words).distinct(), "word", "left_anti")


@lru_cache(maxsize=16)
def _sent(application: str, words: tuple[str, ...]):
    size = sum(len(w.encode()) for w in words)
    if size > SET_BYTES:
        raise ValueError(f"a list of {size} bytes is to be given as a table")
    return SparkSession.active().sparkContext.broadcast(frozenset(words))


def listed_of(candidates: Column, words: tuple[str, ...]) -> Column:
    """Those of an array of texts that the list has; null for a null array."""
    held = _sent(SparkSession.active().sparkContext.applicationId, words)

    def run(arrays: pd.Series) -> pd.Series:
        known = held.value
        return pd.Series([None if a is None else [w for w in a if w in known] for a in arrays], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(candidates)


def with_listed(df: DataFrame, candidates: Column, evidence: DataFrame, out: str) -> DataFrame:
    """`df` with an array `out` of those of `candidates` that the table `evidence` (word) has.

    A join by word, for lists of any length: the distinct words of each row are exploded and joined, what is left is
    gathered by row, at most the row's own words, and joined back. Rows of equal candidates share their answer.
    """
    rows = df.withColumn("_words", F.array_sort(F.array_distinct(candidates)))
    rows = rows.withColumn("_key", F.xxhash64("_words")).withColumn("_key2", F.hash("_words"))
    words = rows.select("_key", "_key2", "_words").dropDuplicates(["_key", "_key2", "_words"])
    met = words.select("_key", "_key2", "_words", F.explode("_words").alias("word")).join(evidence.select("word").distinct(), "word")
    found = met.groupBy("_key", "_key2", "_words").agg(F.collect_list("word").alias(out))
    same = ["_key", "_key2", "_words"]
    empty = F.when(F.col("_words").isNotNull(), F.array().cast("array<string>"))
    return rows.join(found, same, "left").withColumn(out, F.coalesce(out, empty)).drop(*same)
