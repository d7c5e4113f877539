"""From raw documents to token ids: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. The
result of a stage is written as Parquet and reread as the next one's docs. Rows with a null id are treated like others.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.base import checkpoint_dir, removed, table, unused
from tamis.llm.bpe import BytePairs, encoded
from tamis.llm.decontaminate import without_leaks
from tamis.llm.language import UNDETERMINED, fit_familiarity, fit_languages, judged_language
from tamis.llm.secrets import without_secrets
from tamis.llm.simhash import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters, and those that look like none that was learnt, go.

    What a text looks like is judged against the language it is nearest to, by a limit from labelled documents.
    """
    judged = judged_language(F.col("text"), fit_languages(docs), fit_familiarity(docs), docs)
    own = unused(docs, "_judged")
    kept = docs.withColumn(own, judged).where((F.col(f"{own}.lang_pred") != UNDETERMINED) & (F.col(f"{own}.strangeness") <= 1))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Of rows that share that id, one."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secret values replaced; n_chars follows the text."""
    clean = without_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text again."""
    pairs = BytePairs.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = encoded(docs.select("doc_id", "lang", "source", "text"), pairs, again="bytes")
    same = F.col("bytes") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]

#: SQL can express none of the five stages: trained models, 64-bit shingle hashes, edit distances, lexing, ranked merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    top = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        if i:
            removed(spark, f"{top}/{i - 1}")  # what it fed is written
    return STAGES[-1][1](spark, docs, sf_dir)
