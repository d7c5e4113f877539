"""Profiles: boolean trees over findings, compiled to column expressions."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Node, Profile, RuleSet
from .once import once

SEVERITY = {"ALLOW": 0, "ESCALATE": 1, "BLOCK": 2}
PROFILE = "struct<profile_id:string,profile_name:string,data_type:string,verdict_on_match:string,confidence:bigint,severity:int>"


def _leaves(n: Node) -> list[Node]:
    return [n] if n.op == "detector" else [x for y in n.of for x in _leaves(y)]


def _leaf(n: Node) -> str:
    return f"_l_{n.id}_{n.min_count}_{n.min_validated}"


def _confidence(n: Node, rules: RuleSet) -> Column:
    """The greatest confidence among the satisfied parts, null if the node does not hold. An empty `and` holds; an empty
    `or`, a detector that is not declared, and an operation that is not known do not."""
    if n.op == "detector":
        return F.col(_leaf(n)) if rules.detector(n.id) else F.lit(None).cast("bigint")
    parts = [_confidence(x, rules) for x in n.of]
    best = F.greatest(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), *parts)
    if n.op == "and":
        return F.when(reduce(lambda a, b: a & b, (p.isNotNull() for p in parts), F.lit(True)), best)
    if n.op == "or" and parts:
        if max(n.least, 1) == 1:
            return reduce(lambda a, b: F.greatest(a, b), parts)  # of those that are not null
        return F.when(reduce(lambda a, b: a + b, (p.isNotNull().cast("int") for p in parts)) >= n.least, best)
    return F.lit(None).cast("bigint")


def disposition(confidence: Column, p: Profile, rules: RuleSet) -> Column:
    """Severity of a satisfied profile: by the block threshold, but no higher than the profile's ceiling."""
    ceiling = 2 if not p.verdict_on_match else SEVERITY.get(p.verdict_on_match, 0)
    return F.least(F.when(confidence >= rules.confidence.block_threshold, 2).otherwise(1), F.lit(ceiling))


@lru_cache(maxsize=32)
def _compiled(application: str, rules: RuleSet, by: str) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Columns of the leaves, of each profile's confidence, and the array over them."""
    leaves = {_leaf(n): n for p in rules.profiles for n in _leaves(p.match) if rules.detector(n.id)}

    def leaf(n: Node) -> Column:
        f = F.col(by)[n.id]
        held = f["fired"]
        if n.min_validated > 0:
            held = held & (f["validated_count"] >= n.min_validated)
        if n.min_count > 0:
            held = held & (f["raw_count"] >= n.min_count)
        return F.when(held, f["confidence"])

    conf = {f"_c_{p.id}": _confidence(p.match, rules).cast("bigint") for p in rules.profiles}
    each = [
        F.when(
            F.col(f"_c_{p.id}").isNotNull(),
            F.struct(F.lit(p.id).alias("profile_id"), F.lit(p.name or p.id).alias("profile_name"), F.lit(p.data_type).alias("data_type"), F.lit(p.verdict_on_match).alias("verdict_on_match"), F.col(f"_c_{p.id}").alias("confidence"), disposition(F.col(f"_c_{p.id}"), p, rules).alias("severity")),
        ).cast(PROFILE)
        for p in rules.profiles
    ]
    profiles = F.array_compact(F.array(*each)) if each else F.array().cast(f"array<{PROFILE}>")
    return {name: leaf(n) for name, n in leaves.items()}, conf, profiles


def with_profiles(df: DataFrame, rules: RuleSet, by: str = "_by", out: str = "profiles") -> DataFrame:
    """`df` with an array `out` of the satisfied profiles in the order of the rules, from a map `by` of findings by
    detector."""
    leaves, conf, profiles = _compiled(df.sparkSession.sparkContext.applicationId, rules, by)
    df = once(df, leaves) if leaves else df
    df = once(df, conf) if conf else df
    return once(df, {out: profiles}).drop(*conf, *leaves)
