"""The verdict on a document: profiles, labels and coverage, weighed against each other."""

from __future__ import annotations

import json
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import EarlyExit, RuleSet
from .detect import found_array, looked_at
from .labels import LABEL, body_labels
from .once import once
from .profiles import PROFILE, SEVERITY, with_profiles

VERDICTS = sorted(SEVERITY, key=SEVERITY.get)
COVERAGE_NOTE = "only a part of the document was inspected"


def verdict_name(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VERDICTS)), severity.cast("int") + 1)


@lru_cache(maxsize=32)
def fired_detectors(application: str, rules: RuleSet) -> Column:
    """The fired findings of the array `_found` of (id, finding), by descending confidence and then by id."""
    found = F.col("_found")
    names = F.from_json(F.lit(json.dumps({d.id: d.name or d.id for d in rules.detectors})), "map<string,string>")
    kept = F.transform(F.filter(found, lambda x: x["finding"]["fired"]), lambda x: F.struct((-x["finding"]["confidence"]).alias("order"), x["id"].alias("id"), x["finding"]["raw_count"].alias("raw_count"), x["finding"]["validated_count"].alias("validated_count")))
    return F.transform(F.array_sort(kept), lambda x: F.struct(x["id"].alias("id"), names[x["id"]].alias("name"), x["raw_count"].alias("raw_count"), x["validated_count"].alias("validated_count"), (-x["order"]).alias("confidence")))


@lru_cache(maxsize=32)
def _body(application: str, rules: RuleSet) -> Column:
    return body_labels(F.col("_text"), rules)


def _batches(rules: RuleSet) -> list[tuple[str, ...]]:
    ids, n = tuple(d.id for d in rules.by_priority), max(1, rules.early_exit.batch)
    return [ids[i : i + n] for i in range(0, len(ids), n)]


def _with_found(df: DataFrame, rules: RuleSet) -> DataFrame:
    """`df` with `_found` and `short_circuited`. With an early exit, batches after the one that ended the scan are not
    scanned for. Batches have a fixed size, so the result does not depend on the machine."""
    given = set(df.columns)
    df = looked_at(df, rules, "_text")
    own = [c for c in df.columns if c not in given]
    if not rules.early_exit.enabled:
        return found_array(df, rules).withColumn("short_circuited", F.lit(False)).drop(*own)
    batches = _batches(rules)
    df = found_array(df, rules, batches[0] if batches else ()).withColumn("short_circuited", F.lit(False))
    for batch in batches[1:]:
        df = with_profiles(once(df, {"_by": F.map_from_entries("_found")}), rules, out="_so_far")
        ends = F.exists("_so_far", lambda p: p["severity"] == 2) if rules.early_exit.stop_on_block else F.lit(False)
        if most := rules.early_exit.max_total_matches:
            ends = ends | (F.aggregate("_found", F.lit(0).cast("bigint"), lambda n, x: n + x["finding"]["raw_count"]) >= most)
        df = df.withColumn("short_circuited", F.col("short_circuited") | ends).drop("_so_far", "_by")
        df = found_array(df, rules, batch, "short_circuited", "_more")
        df = once(df.withColumnRenamed("_found", "_before"), {"_found": F.concat("_before", "_more")}).drop("_before", "_more")
    return df.drop(*own)


def _clock() -> Column:
    """The task's clock in nanoseconds, read when a row comes by."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")


def inspect(df: DataFrame, rules: RuleSet, text_col: str = "text", source_labels: str | None = None, partial: str | None = None, truncated: str | None = None, error: str | None = None, micros: bool = False) -> DataFrame:
    """`df` with verdict, bytes_seen, profiles, labels, detectors, short_circuited and note; with `micros` also how long the
    row took, measured in its task from where its text is there to where its verdict is.

    A map over rows: no shuffle, and the same on streams. `source_labels`, `partial`, `truncated` and `error` name columns
    of an extraction: metadata labels force BLOCK, an incomplete look at what would be ALLOW gives ESCALATE, and a
    document without text because of an error is ESCALATE, or ALLOW where the format is just not supported (the error
    then starts with "unsupported"). A null text counts as empty.
    """
    given, none = df.columns, F.array().cast(f"array<{LABEL}>")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name else F.lit(False)
    df = df.select(  # what was given is out of the way of names that are used here
        *[F.col(f"`{c}`").alias(f"_given{i}") for i, c in enumerate(given)],
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
        (F.coalesce(F.col(source_labels), none) if source_labels else none).alias("_meta"),
        (flag(partial) | flag(truncated)).alias("_in_part"),
        (F.col(error) if error else F.lit(None).cast("string")).alias("_error"),
    )
    if micros:
        df = once(df, {"_began": _clock()})
    df = once(_with_found(df, rules), {"_by": F.map_from_entries("_found")})
    df = with_profiles(df, rules)
    application = df.sparkSession.sparkContext.applicationId
    df = once(df, {"_body": _body(application, rules), "_detectors": fired_detectors(application, rules)})
    severity = F.coalesce(F.array_max(F.transform("profiles", lambda p: p["severity"])), F.lit(0))
    severity = F.greatest(severity, F.when(F.size("_body") > 0, 1).otherwise(0), F.when(F.size("_meta") > 0, 2).otherwise(0))
    uncovered = F.col("_in_part") & (severity == 0)
    without = F.when(F.size("_meta") > 0, 2).when(F.startswith("_error", F.lit("unsupported")), 0).otherwise(1)
    severity = F.when(F.col("_error").isNotNull(), without).when(uncovered, 1).otherwise(severity)
    note = F.coalesce("_error", F.when(uncovered, COVERAGE_NOTE))
    df = once(df, {"_severity": severity, "_note": note})
    if micros:
        took = F.floor((_clock() - F.col("_began")) / 1000).cast("bigint")
        df = once(df, {"_micros": took + F.coalesce(F.col(f"_given{given.index('micros')}"), F.lit(0)) if "micros" in given else took})
    new = {
        "verdict": verdict_name(F.col("_severity")),
        "bytes_seen": F.octet_length("_text").cast("bigint"),
        "labels": F.concat("_meta", "_body"),
        "detectors": F.col("_detectors"),
        "note": F.col("_note"),
    }
    kept = [F.col(f"_given{i}").alias(c) for i, c in enumerate(given) if c not in ("profiles", "short_circuited", *new) and not (micros and c == "micros")]
    profiles = F.transform("profiles", lambda p: p.dropFields("severity")).alias("profiles")
    new = {name: column.alias(name) for name, column in new.items()}
    return df.select(*kept, new["verdict"], new["bytes_seen"], profiles, new["labels"], new["detectors"], "short_circuited", new["note"], *([F.col("_micros").alias("micros")] if micros else []))


def profiles_long(df: DataFrame, rules: RuleSet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and satisfied profile: doc_id, profile_id, verdict_on_match, confidence, disposition."""
    found = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    found = with_profiles(_with_found(found, replace(rules, early_exit=EarlyExit())).withColumn("_by", F.map_from_entries("_found")), rules)
    flat = F.transform("profiles", lambda p: F.struct(*[p[c].alias(c) for c in ("profile_id", "verdict_on_match", "confidence")], verdict_name(p["severity"]).alias("disposition")))
    return found.select("doc_id", F.inline(flat))


__all__ = ["PROFILE", "VERDICTS", "fired_detectors", "inspect", "profiles_long", "verdict_name"]
