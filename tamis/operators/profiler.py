"""Reports on many verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import RuleSet
from .verdict import VERDICTS


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """verdict, n, share (in percent, rounded down to hundredths), place: all three verdicts, in order of severity."""
    spark = verdicts.sparkSession
    every = spark.range(len(VERDICTS)).select(F.element_at(F.array(*map(F.lit, VERDICTS)), (F.col("id") + 1).cast("int")).alias("verdict"), "id")
    counts = verdicts.groupBy("verdict").agg(F.count("*").alias("n"))
    out = every.join(counts, "verdict", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the three rows
    return out.select("verdict", "n", F.coalesce(F.floor(F.col("n") * 10000 / F.nullif(total, F.lit(0))), F.lit(0)).cast("bigint").alias("share"), F.col("id").alias("place"))


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value of a column, the most frequent first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def floor_percentiles(rows: DataFrame, column: str, quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(q, value): the value at place floor((n - 1) q), from 0, of the column in order; nulls do not count.

    The places are found from counts by value, which are ordered in ranges; no list of all values is gathered.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("of_part"))
    before = F.coalesce(F.sum("of_part").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"), F.sum("of_part").over(Window.partitionBy(F.lit(1))).alias("total"))  # a row for each partition
    placed = ranged.withColumn("upto", F.sum("n").over(inside)).join(parts, "part")
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    placed = placed.select("value", (F.col("before") + F.col("upto") - F.col("n")).alias("low"), (F.col("before") + F.col("upto")).alias("high"), "total", wanted)
    place = F.floor((F.col("total") - 1) * F.col("q"))
    return placed.where((place >= F.col("low")) & (place < F.col("high"))).select("q", "value")


def size_summary(rows: DataFrame, column: str) -> DataFrame:
    """n, total, mean (whole, rounded down) and max of a whole-number column."""
    return rows.agg(F.count(column).alias("n"), F.sum(column).cast("bigint").alias("total"), F.expr(f"cast(sum(`{column}`) div count(`{column}`) as bigint)").alias("mean"), F.max(column).alias("max"))


def top_k(rows: DataFrame, column: str, tie: str, k: int) -> DataFrame:
    """The k rows of the greatest values; ties by `tie`."""
    return rows.orderBy(F.desc(column), tie).limit(k)


def latency_report(verdicts: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(metric, value) of the measured `micros`: n, bytes, seconds, mean_micros, max_micros, mb_per_s (of the time in tasks),
    and p50, p90 and so on. Rows without a measurement do not count; without any, there are n, bytes and seconds of 0."""
    timed = verdicts.where(F.col("micros").isNotNull())
    took, size = F.coalesce(F.sum("micros"), F.lit(0)).cast("double"), F.coalesce(F.sum("bytes_seen"), F.lit(0)).cast("double")
    whole = timed.agg(
        F.count("*").cast("double").alias("n"), size.alias("bytes"), (took / 1e6).alias("seconds"), F.avg("micros").alias("mean_micros"),
        F.max("micros").cast("double").alias("max_micros"), (size / F.nullif(took, F.lit(0.0))).alias("mb_per_s"),
    )
    metrics = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in whole.columns])
    rows = whole.select(F.inline(metrics)).where("value is not null")
    places = floor_percentiles(timed, "micros", quantiles)
    return rows.unionByName(places.select(F.format_string("p%.0f", F.col("q") * 100).alias("metric"), F.col("value").cast("double").alias("value")))


def slowest(verdicts: DataFrame, k: int, tie: str = "path") -> DataFrame:
    """The k rows that took longest."""
    return top_k(verdicts.where(F.col("micros").isNotNull()), "micros", tie, k)


def expectation_report(verdicts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Verdicts held against expected ones: key, verdict, expected_verdict, missing, extra, status.

    `expected` has the key, `verdict` and `profiles` (an array of ids that must be among those found). `missing` are expected
    profiles that were not found, `extra` found ones that were not expected. status: "absent" for an expected document
    without a verdict, "unexpected" for a verdict that nothing was said of, "differs" in the verdict, "missing" a profile, or
    "ok". Keys tell documents apart; null keys meet nothing.
    """
    found = verdicts.select(F.col(key).alias("k"), F.col("verdict").alias("got"), F.array_sort(F.array_distinct(F.col("profiles.profile_id"))).alias("had"))
    wanted = expected.select(F.col(key).alias("k2"), F.col("verdict").alias("want"), F.array_sort(F.array_distinct("profiles")).alias("must"))
    both = found.join(wanted, F.col("k") == F.col("k2"), "full_outer")
    none = F.array().cast("array<string>")
    had, must = F.coalesce("had", none), F.coalesce("must", none)
    missing, extra = F.array_except(must, had), F.array_except(had, must)
    status = F.when(F.col("got").isNull(), "absent").when(F.col("want").isNull(), "unexpected").when(F.col("got") != F.col("want"), "differs").when(F.size(missing) > 0, "missing").otherwise("ok")
    return both.select(F.coalesce("k", "k2").alias(key), F.col("got").alias("verdict"), F.col("want").alias("expected_verdict"), missing.alias("missing"), extra.alias("extra"), status.alias("status"))


def write_csv(verdicts: DataFrame, path: str) -> None:
    """path, size, type, verdict, micros, partial, short_circuit; micros are empty where they were not measured. Latencies,
    their report and this file come from one run if the verdicts were written or cached before."""
    micros = F.col("micros") if "micros" in verdicts.columns else F.lit(None).cast("bigint")
    columns = [F.col("path"), F.col("length").alias("size"), F.col("file_type").alias("type"), F.col("verdict"), micros.alias("micros"), F.col("partial"), F.col("short_circuited").alias("short_circuit")]
    verdicts.select(*columns).write.mode("overwrite").csv(path, header=True)


def rules_table(spark, rules: RuleSet) -> DataFrame:
    """One row for each detector: id, kind, compat, patterns, validators, problems."""
    rows = [(d.id, d.kind, d.compat, len(d.patterns), list(d.validators), d.problems) for d in rules.detectors]
    return spark.createDataFrame(rows, "id string, kind string, compat string, patterns int, validators array<string>, problems array<string>")


def compat_report(spark, rules: RuleSet) -> DataFrame:
    return type_counts(rules_table(spark, rules), "compat")


def unresolved_references(spark, rules: RuleSet) -> DataFrame:
    """(profile_id, detector) of profiles that name a detector that is not declared."""
    refs = spark.createDataFrame([(p.id, r) for p in rules.profiles for r in sorted(p.match.references())], "profile_id string, detector string")
    known = spark.createDataFrame([(d.id,) for d in rules.detectors], "detector string")
    return refs.join(known, "detector", "left_anti").select("profile_id", "detector")
