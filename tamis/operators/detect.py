"""Detectors over texts: matches, their places, and scored findings.

A row has one array with the matches of every detector that has any; only there is an expression for each detector. What
follows (checksums, keywords nearby, points) is said once, over that array, with the rules beside it as a table in one
literal: plans stay small however many rules there are. There is no shuffle, and streams work alike. The long form has one
row for each match, for analytics.

Most patterns have a reach: a match has a digit and no more than so many characters. One search finds the stretches of a
text without a digit; all patterns with a reach are then tried on what is left around the digits, which in prose is next to
nothing. A match and its place come from the same search.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import re2, validators
from ..plans.rules import Detector, RuleSet
from . import lexicons
from .lexicons import listed_of
from .names import capitalised, name_finding
from .once import once
from .places import found, near, near_digits, readable

#: Matches of a detector in one document that findings look at.
MAX_MATCHES = 64
SAMPLES = 3
FINDING = "struct<raw_count:bigint,validated_count:bigint,keyword_found:boolean,confidence:bigint,fired:boolean,samples:array<string>>"
_FOUND = f"array<struct<id:string,finding:{FINDING}>>"
_HITS = "array<struct<at:int,m:array<struct<start:int,value:string>>>>"
#: Patterns of a longer reach are tried on whole texts.
LONGEST_REACH = 256
_RULE = "struct<id:string,name:string,base:int,validators:array<string>,keywords:array<string>,best_effort:boolean>"


def has_digit(text: Column) -> Column:
    return has_any(text, tuple("0123456789"))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether `text` contains any of `words`, as they are written. Plain searches over bytes: a pattern with the words as
    alternatives would take many times as long."""
    return _any([F.contains(text, F.lit(w)) for w in words])


def _any(tests: list[Column]) -> Column:
    """Their disjunction, as a flat tree."""
    if len(tests) < 2:
        return tests[0] if tests else F.lit(False)
    return _any(tests[: len(tests) // 2]) | _any(tests[len(tests) // 2 :])


def guard(d: Detector, text: Column, lower: Column, digit: Column) -> Column:
    """Whether the detector's patterns are tried at all: its literals or a digit (or what may stand for one) must be
    there, and for a best-effort detector a keyword."""
    tests = [digit | has_any(text, d.digit_or) if d.digit_or else digit] if d.needs_digit else []
    if d.literals:
        tests.append(has_any(text, d.literals))
    if d.best_effort:
        tests.append(has_any(lower, tuple(k.lower() for k in d.keywords)))
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def all_matches(text: Column, pattern: str, limit: int | None = MAX_MATCHES) -> Column:
    """The first `limit` matches (None: all), leftmost and not overlapping."""
    found = F.regexp_extract_all(text, F.lit(re2.to_java(pattern)), F.lit(0))
    return found if limit is None else F.slice(found, 1, limit)


def _usable(rules: RuleSet, ids: tuple[str, ...] | None = None) -> list[Detector]:
    return [d for d in rules.detectors if d.kind == "regex" and d.pattern and (ids is None or d.id in ids)]


def _table(detectors: list[Detector]) -> Column:
    """The rules that the generic part needs, as one array; `hits` refer to its places, from 0."""
    rows = [{"id": d.id, "name": d.name or d.id, "base": d.base, "validators": list(d.validators), "keywords": [k.lower() for k in d.keywords], "best_effort": d.best_effort} for d in detectors]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{_RULE}>")


@lru_cache(maxsize=4096)
def _reach(pattern: str) -> int | None:
    n = re2.reach(pattern)
    return n if n is not None and n <= LONGEST_REACH else None


def _by_set(d: Detector) -> bool:
    return d.kind == "dictionary" and len(d.dictionary.evidence) > lexicons.LITERAL_WORDS


@lru_cache(maxsize=64)
def _seen(application: str, text_col: str) -> dict[str, Column]:
    text = F.col(text_col).cast("string")
    return {"_seen": readable(text), "_lower": F.lower(text), "_digit": has_digit(text)}


@lru_cache(maxsize=64)
def _near(application: str, context: int) -> Column:
    return F.when(F.col("_digit"), near_digits(F.col("_seen"), context))


def looked_at(df: DataFrame, rules: RuleSet, text_col: str, ids: tuple[str, ...] | None = None) -> DataFrame:
    """`df` with what all detectors look at: `_seen`, the text; `_lower`; `_digit`; `_near`, the parts around digits that
    patterns with a reach are tried on; and of a detector with long lists `_listed_<id>`, the words of the text in them."""
    application = df.sparkSession.sparkContext.applicationId
    df = once(df, _seen(application, text_col))
    long = {f"_listed_{d.id}": listed_of(capitalised(F.col("_seen")), d.dictionary.evidence) for d in rules.detectors if _by_set(d) and (ids is None or d.id in ids)}
    df = once(df, long) if long else df
    reaches = [n for d in _usable(rules, ids) if (n := _reach(d.pattern)) is not None]
    return once(df, {"_near": _near(application, max(reaches, default=0) + 1)})


def _hits(detectors: list[Detector], limit: int | None) -> Column:
    """An array of (at, m): the place in the table of each detector that has matches, and its matches with their places, from
    the columns of `looked_at`."""
    text, lower, digit, parts = F.col("_seen"), F.col("_lower"), F.col("_digit"), F.col("_near")

    def matches(d: Detector) -> Column:
        java = re2.to_java(d.pattern)
        if _reach(d.pattern) is None:
            return F.when(guard(d, text, lower, digit), found(text, java, limit))
        within = F.flatten(F.transform(parts, lambda p: F.transform(found(p["part"], java, limit), lambda h: F.struct((h["start"] + p["at"]).alias("start"), h["value"].alias("value")))))
        return F.when(digit & guard(d, text, lower, digit), within if limit is None else F.slice(within, 1, limit))

    each = [F.struct(F.lit(i).alias("at"), matches(d).alias("m")) for i, d in enumerate(detectors)]
    return F.filter(F.array(*each), lambda x: F.size(x["m"]) > 0).cast(_HITS) if each else F.array().cast(_HITS)


def _valid(value: Column, names: Column, known: set[str]) -> Column:
    """Whether `value` passes all the validators that `names` has."""

    def passes(name: Column) -> Column:
        tests = [(name == v, validators.run(v, value)) for v in sorted(known & set(validators.VALIDATORS))]
        if not tests:
            return F.lit(False)
        out = F.when(*tests[0])
        for test in tests[1:]:
            out = out.when(*test)
        return out.otherwise(False)

    return F.forall(names, passes) if known else F.lit(True)


def _known(detectors: list[Detector]) -> set[str]:
    return {v for d in detectors for v in d.validators}


def _scored(detectors: list[Detector], rules: RuleSet, table: Column, lower: Column):
    """From (at, m) to (id, finding)."""
    c, known = rules.confidence, _known(detectors)

    def score(x: Column) -> Column:
        r, m = F.get(table, x["at"]), x["m"]
        count = F.size(m).cast("bigint")
        checked = F.size(r["validators"]) > 0
        validated = F.when(checked, F.size(F.filter(m, lambda v: _valid(v["value"], r["validators"], known))).cast("bigint")).otherwise(count)
        anywhere = F.exists(r["keywords"], lambda k: F.contains(lower, k))
        close = F.when(anywhere, F.exists(m, lambda v: near(lower, v["start"], r["keywords"], c.keyword_window))).otherwise(False)
        given = F.struct(count.alias("n"), validated.alias("good"), close.alias("keyword"), r.alias("r"), m.alias("m"))
        return F.element_at(F.transform(F.array(given), points), 1)  # each is worked out once

    def points(x: Column) -> Column:
        r, checked = x["r"], F.size(x["r"]["validators"]) > 0
        total = r["base"] + F.when(x["keyword"], c.keyword_boost).otherwise(0) + F.when(checked & (x["good"] > 0), c.validator_boost).otherwise(0)
        total = F.least(total + F.least(x["n"] - 1, F.lit(c.max_instance_boosts)) * c.instance_boost, F.lit(100)).cast("bigint")
        fired = (total >= c.fire_threshold) & (~checked | (x["good"] > 0)) & (~r["best_effort"] | x["keyword"])
        finding = F.struct(x["n"].alias("raw_count"), x["good"].alias("validated_count"), x["keyword"].alias("keyword_found"), total.alias("confidence"), fired.alias("fired"), F.transform(F.slice(x["m"], 1, SAMPLES), lambda v: v["value"]).alias("samples"))
        return F.struct(r["id"].alias("id"), finding.alias("finding"))

    return score


def registry() -> tuple:
    """What rules compile to depends on the validators that are known by now."""
    return tuple(sorted((name, id(v)) for name, v in validators.VALIDATORS.items()))


@lru_cache(maxsize=32)
def _compiled(application: str, known: tuple, rules: RuleSet, ids: tuple[str, ...] | None, unless: str | None) -> tuple[Column, dict[str, Column], Column]:
    """Columns by name, so that one compilation serves every table: the hits, name findings, and all findings over them."""
    text, lower = F.col("_seen"), F.col("_lower")
    detectors = _usable(rules, ids)
    hits = _hits(detectors, MAX_MATCHES)
    hits = F.when(~F.col(unless), hits).otherwise(F.array().cast(_HITS)) if unless else hits
    out, by_names = [F.transform("_hits", _scored(detectors, rules, _table(detectors), lower)).cast(_FOUND)], {}
    for d in rules.detectors:
        if d.kind == "dictionary" and (ids is None or d.id in ids):
            finding = name_finding(d, rules.confidence, text, lower, F.col(f"_listed_{d.id}") if _by_set(d) else None)
            by_names[f"_n_{d.id}"] = (F.when(~F.col(unless), finding) if unless else finding).cast(FINDING)
            one = F.array(F.struct(F.lit(d.id).alias("id"), F.col(f"_n_{d.id}").alias("finding")))
            out.append(F.when(F.col(f"_n_{d.id}").isNotNull(), one).otherwise(F.array()).cast(_FOUND))
    return hits, by_names, F.concat(*out)


def found_array(df: DataFrame, rules: RuleSet, ids: tuple[str, ...] | None = None, unless: str | None = None, out: str = "_found") -> DataFrame:
    """`df`, which has the columns of `looked_at`, with an array `out` of (id, finding) of the detectors in `ids` (None: all)
    that have a finding. Where the column `unless` is true nothing is looked for, and the array is empty."""
    hits, by_names, every = _compiled(df.sparkSession.sparkContext.applicationId, registry(), rules, ids, unless)
    return once(once(df, {"_hits": hits, **by_names}), {out: every}).drop("_hits", *by_names)


def with_findings(df: DataFrame, rules: RuleSet, text_col: str = "text") -> DataFrame:
    """`df` with a column `f_<detector>` for every detector: null, or its finding. A null text has none.

    Texts are looked at whole. Columns of `df` named f_... of a detector are replaced.
    """
    names = {d.id: f"f_{d.id}" for d in rules.detectors}
    given = {c: f"_given{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(f"`{c}`").alias(new) for c, new in given.items()], F.col(text_col).alias("_source"))
    rows = once(found_array(looked_at(rows, rules, "_source"), rules), {"_by": F.map_from_entries("_found")})
    kept = [F.col(new).alias(c) for c, new in given.items() if c not in names.values()]
    return rows.select(*kept, *[F.col("_by")[i].alias(name) for i, name in names.items()])


def matches_long(df: DataFrame, rules: RuleSet, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """One row for each match: doc_id, detector, ord (from 1), start (byte), value, valid. `limit` keeps the first so many
    of each detector and document; by default all are given."""
    base = looked_at(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_source")), rules, "_source")
    hits, rule, check = _compiled_matches(df.sparkSession.sparkContext.applicationId, registry(), rules, limit)
    rows = base.select("doc_id", F.explode(hits).alias("h")).select("doc_id", rule.alias("r"), F.posexplode("h.m").alias("at", "x"))
    return rows.select("doc_id", F.col("r.id").alias("detector"), (F.col("at") + 1).cast("bigint").alias("ord"), F.col("x.start").cast("bigint").alias("start"), F.col("x.value").alias("value"), check.alias("valid"))


@lru_cache(maxsize=64)
def _compiled_matches(application: str, known: tuple, rules: RuleSet, limit: int | None) -> tuple[Column, Column, Column]:
    """The hits, the rule of a hit `h`, and whether a value `x` of the rule `r` is valid."""
    detectors = _usable(rules)
    valid = F.when(F.size("r.validators") > 0, _valid(F.col("x.value"), F.col("r.validators"), _known(detectors))).otherwise(True)
    return _hits(detectors, limit), F.get(_table(detectors), F.col("h.at")), valid


def findings_long(df: DataFrame, rules: RuleSet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and detector with a finding."""
    base = looked_at(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_source")), rules, "_source")
    fields = ("raw_count", "validated_count", "keyword_found", "confidence", "fired")
    flat = F.transform("_found", lambda x: F.struct(x["id"].alias("detector"), *[x["finding"][c].alias(c) for c in fields]))
    return found_array(base, rules).select("doc_id", F.inline(flat))
