"""The same inspection over streams: texts or files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.verdict import inspect
from ..plans.rules import RuleSet
from ..sources.extract import ExtractOptions
from ..sources.files import inspect_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def inspect_texts(stream: DataFrame, rules: RuleSet, text_col: str = "text") -> DataFrame:
    """Verdicts on a stream of texts. Nothing is kept between rows, so any output mode but complete works."""
    return inspect(stream, rules, text_col)


def inspect_folder(spark: SparkSession, path: str, rules: RuleSet, options: ExtractOptions | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Verdicts on files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(path)
    return inspect_files(files.select("path", "length", "content"), rules, options)


def write_verdicts(verdicts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, exactly once, as Parquet."""
    return verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
