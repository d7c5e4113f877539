"""Keywords near matches as a join of rows: for analytics over texts of any length, in which both are many.

The row-wise form of the findings looks around each match within its text. Here keywords and matches are rows, and a
match meets the keywords of its document in buckets as wide as the window: its own bucket and the two beside it. A long
document is spread over its buckets, and no task holds all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import RuleSet
from .detect import matches_long
from .literals import literal_places


def keyword_places(df: DataFrame, rules: RuleSet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each keyword of each detector where it stands in the lower-case text: doc_id, detector, keyword, start, end
    (bytes). The keywords of all detectors are found in one pass."""
    of: dict[str, list[str]] = {}
    for d in rules.detectors:
        for k in dict.fromkeys(k.lower() for k in d.keywords):
            of.setdefault(k, []).append(d.id)
    words = list(of)
    empty = F.array().cast("array<array<string>>")
    owners = F.array(*[F.array(*map(F.lit, of[k])) for k in words]) if words else empty
    names = F.array(*map(F.lit, words)).cast("array<string>")
    rows = df.select(F.col(id_col).alias("doc_id"), F.explode(literal_places(F.lower(F.col(text_col).cast("string")), words)).alias("x"))
    rows = rows.select("doc_id", F.explode(F.get(owners, F.col("x.word"))).alias("detector"), F.get(names, F.col("x.word")).alias("keyword"), "x.start", "x.end")
    return rows


def near_pairs(matches: DataFrame, keywords: DataFrame, window: int) -> DataFrame:
    """The matches (doc_id, detector, ord, start, ...) with a keyword of their detector that lies whole within `window` bytes
    of their start, once for each such keyword: their columns, keyword, keyword_start. A band join: equal in document,
    detector and bucket, and then by place."""
    width = max(1, window)
    bucket = lambda c: F.floor(F.col(c) / width)
    left = matches.withColumn("_bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: bucket("start") + i)))
    right = keywords.select("doc_id", "detector", "keyword", F.col("start").alias("keyword_start"), F.col("end").alias("_end"), bucket("start").alias("_bucket"))
    both = left.join(right, ["doc_id", "detector", "_bucket"])
    within = (F.col("keyword_start") >= F.col("start") - window) & (F.col("_end") <= F.col("start") + window)
    return both.where(within).select(*matches.columns, "keyword", "keyword_start")


def matches_near_keywords(df: DataFrame, rules: RuleSet, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """The rows of `matches_long` with `near_keyword`: whether a keyword of the detector lies whole within the rules' window.
    Ids tell documents apart; of rows that share one, each meets the keywords of all."""
    matches = matches_long(df, rules, id_col, text_col, limit)
    met = near_pairs(matches.select("doc_id", "detector", "ord", "start"), keyword_places(df, rules, id_col, text_col), rules.confidence.keyword_window)
    met = met.select("doc_id", "detector", "ord", "start").distinct().withColumn("near_keyword", F.lit(True))
    out = matches.join(met, ["doc_id", "detector", "ord", "start"], "left")
    return out.select(*matches.columns, F.coalesce("near_keyword", F.lit(False)).alias("near_keyword"))
