"""Files and texts as tables, and the whole way from files to verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verdict import inspect
from ..plans.rules import RuleSet
from .extract import ExtractOptions, extracted
from .tree import file_tree


def scan_files(spark: SparkSession, path: str | list[str], recursive: bool = True, max_read_bytes: int | None = None, max_files: int | None = None, skip_suffix: str | None = None, hidden: bool = False) -> DataFrame:
    """(path, length, content) of the files below `path`, dot-files and empty files among them, links not; folders whose name
    starts with a dot only if `hidden`. Limits and suffixes are met while listing. `max_files` takes the first of the walk in
    the order of names. A file that can't be read has a null content."""
    paths = [path] if isinstance(path, str) else path
    trees = [file_tree(spark, p, recursive=recursive, includeHidden=hidden, maxReadBytes=max_read_bytes, maxFiles=max_files, skipSuffix=skip_suffix) for p in paths]
    full = F.when(F.startswith("path", F.lit("/")), F.concat(F.lit("file:"), "path")).otherwise(F.col("path"))  # as Spark's own sources name files
    files = reduce(DataFrame.unionByName, trees).select(full.alias("path"), "length", "content")
    return files if max_files is None or len(paths) == 1 else files.limit(max_files)


def from_memory(spark: SparkSession, documents: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(n, len(c), c) for n, c in documents], "path string, length bigint, content binary")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A word a line: trimmed, in lower case, each once."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def inspect_files(files: DataFrame, rules: RuleSet, options: ExtractOptions | None = None) -> DataFrame:
    """One verdict for each file: path, length, file_type, verdict, bytes_seen, partial, truncated, profiles, labels,
    detectors, short_circuited, note, micros. The text itself is not kept. Works on batches and streams alike. `micros` is
    what reading the file's format and inspecting its text took in the task."""
    verdicts = inspect(extracted(files, rules, options), rules, "text", "source_labels", "partial", "truncated", "error", micros=True)
    seen = F.when(F.col("error").isNotNull(), F.col("length")).otherwise(F.col("bytes_seen"))
    return verdicts.withColumn("bytes_seen", seen).drop("text", "source_labels", "error")


VERDICT = (
    "path string, length bigint, file_type string, verdict string, bytes_seen bigint, partial boolean, truncated boolean, short_circuited boolean, note string, micros bigint, "
    "profiles array<struct<profile_id:string,profile_name:string,data_type:string,verdict_on_match:string,confidence:bigint>>, "
    "labels array<struct<marker_id:string,label:string,source:string,property:string>>, "
    "detectors array<struct<id:string,name:string,raw_count:bigint,validated_count:bigint,confidence:bigint>>"
)


def read_verdicts(stored: DataFrame, json_col: str = "json", more: str = "") -> DataFrame:
    """Verdicts from stored JSON texts, one a row, typed as `inspect_files` gives them, so that reports run on them; `more`
    names further fields with their types. `problem` holds a text that is no JSON object; its fields are null. Fields that
    are not known are left out, missing ones are null."""
    schema = VERDICT + (f", {more}" if more else "") + ", problem string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "problem"}
    return stored.select(F.from_json(F.col(json_col), schema, options).alias("v")).select("v.*")


def verdict_json(verdicts: DataFrame) -> DataFrame:
    """Each verdict as one JSON text, under `json`."""
    return verdicts.select(F.to_json(F.struct(*verdicts.columns)).alias("json"))
