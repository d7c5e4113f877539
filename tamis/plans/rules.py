"""Rules as data: detectors, profiles and label markers, read from a dictionary or a JSON file and checked once."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import cached_property

from ..functions import re2
from ..functions.validators import VALIDATORS


@dataclass(frozen=True)
class Confidence:
    """Points of a finding: boosts, the window of bytes around a match for keywords, and the thresholds."""

    validator_boost: int = 10
    keyword_boost: int = 5
    instance_boost: int = 5
    max_instance_boosts: int = 3
    keyword_window: int = 200
    fire_threshold: int = 50
    block_threshold: int = 65


@dataclass(frozen=True)
class EarlyExit:
    """Detectors run in batches, by priority; later ones do not count once one of these holds. Off by default."""

    enabled: bool = False
    stop_on_block: bool = True
    max_total_matches: int = 0
    batch: int = 8


@dataclass(frozen=True)
class Dictionary:
    """Word lists of a name detector, and its scoring."""

    given_names: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    common_words: frozenset[str] = frozenset()
    titles: frozenset[str] = frozenset()
    max_span_tokens: int = 3
    name_hit: int = 2
    adjacency: int = 3
    title: int = 3
    keyword: int = 1
    fire: int = 5

    @cached_property
    def evidence(self) -> tuple[str, ...]:
        return tuple(sorted((self.given_names | self.surnames) - self.common_words))


@dataclass(frozen=True)
class Detector:
    id: str
    base: int
    patterns: tuple[str, ...] = ()
    validators: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    name: str = ""
    group: str = ""
    kind: str = "regex"
    data_types: tuple[str, ...] = ()
    best_effort: bool = False
    literals: tuple[str, ...] = ()
    needs_digit: bool = False
    digit_or: tuple[str, ...] = ()
    dictionary: Dictionary | None = None

    @property
    def problems(self) -> list[str]:
        return [f"{p}: {why}" for p in self.patterns if (why := re2.classify(p))]

    @property
    def compat(self) -> str:
        return "CLOUD_ONLY" if self.problems else "LOCAL_FULL"

    @property
    def pattern(self) -> str | None:
        """All patterns that RE2 takes, as alternatives."""
        good = [p for p in self.patterns if re2.classify(p) is None]
        return good[0] if len(good) == 1 else "|".join(f"(?:{p})" for p in good) or None

    @property
    def priority(self) -> int:
        return self.base + 20 * bool(self.validators) - 100 * self.best_effort


@dataclass(frozen=True)
class Node:
    """A detector by id with the least counts, or `and` / `or` over other nodes (`or`: at least `least` of them)."""

    op: str
    id: str = ""
    least: int = 1
    min_count: int = 0
    min_validated: int = 0
    of: tuple[Node, ...] = ()

    def references(self) -> set[str]:
        return {self.id} if self.op == "detector" else set().union(*(n.references() for n in self.of))


@dataclass(frozen=True)
class Profile:
    id: str
    match: Node
    verdict_on_match: str = "BLOCK"
    name: str = ""
    data_type: str = ""


@dataclass(frozen=True)
class Marker:
    id: str
    name: str = ""
    strings: tuple[str, ...] = ()
    metadata_properties: tuple[str, ...] = ()

    @property
    def distinctive(self) -> tuple[str, ...]:
        """Strings that may be looked for in a text: those with a space, or in capitals throughout."""
        return tuple(s for s in self.strings if " " in s or s == s.upper())


@dataclass(frozen=True)
class RuleSet:
    detectors: tuple[Detector, ...]
    profiles: tuple[Profile, ...]
    markers: tuple[Marker, ...] = ()
    confidence: Confidence = field(default_factory=Confidence)
    early_exit: EarlyExit = field(default_factory=EarlyExit)
    schema_version: str = "1"

    def detector(self, name: str) -> Detector | None:
        return next((d for d in self.detectors if d.id == name), None)

    @property
    def by_priority(self) -> list[Detector]:
        return sorted(self.detectors, key=lambda d: -d.priority)

    @classmethod
    def from_dict(cls, x: dict, lexicons: dict[str, frozenset[str]] | None = None, folder: str | None = None) -> RuleSet:
        """From decoded JSON; keys that are not known are ignored. A word list is named by a key of `lexicons`, or else by
        the path of a file below `folder`; KeyError if there is neither."""
        given = dict(lexicons or {})

        def words_of(name: str) -> frozenset[str]:
            if name not in given and folder is not None and os.path.isfile(path := os.path.join(folder, name)):
                with open(path, encoding="utf-8") as f:
                    given[name] = frozenset(w for line in f if (w := line.strip().lower()))
            return given[name]

        own = lambda kind, d: kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in kind.__dataclass_fields__})

        def node(d: dict) -> Node:
            return own(Node, d | {"of": [node(n) for n in d.get("of", [])]})

        detectors = []
        for d in x.get("detectors", []):
            if words := d.get("dictionary"):
                lists = {k: words_of(words[k]) for k in ("given_names", "surnames", "common_words") if words.get(k)}
                words = own(Dictionary, {k: v for k, v in words.items() if k not in lists and k != "titles"} | lists | {"titles": frozenset(t.lower() for t in words.get("titles", []))})
            detectors.append(own(Detector, d | {"dictionary": words}))
        profiles = [own(Profile, p | {"match": node(p["match"])}) for p in x.get("profiles", [])]
        return cls(
            tuple(detectors),
            tuple(profiles),
            tuple(own(Marker, m) for m in x.get("markers", [])),
            own(Confidence, x.get("confidence", {})),
            own(EarlyExit, x.get("early_exit", {})),
            str(x.get("schema_version", "1")),
        )

    @classmethod
    def load(cls, path: str, lexicons: dict[str, frozenset[str]] | None = None) -> RuleSet:
        """From a JSON file; word lists are looked for beside it."""
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f), lexicons, os.path.dirname(os.path.abspath(path)))

    def lint(self) -> list[tuple[str, str, str]]:
        """(severity, subject, problem): what a careful author would mend. Errors come first."""
        out = []
        ids = [d.id for d in self.detectors]
        for d in self.detectors:
            out += [("error", d.id, f"not an RE2 pattern: {why}") for why in d.problems]
            out += [("warning", d.id, f"validator {v} is not known and never holds") for v in d.validators if v not in VALIDATORS]
            if d.kind == "dictionary" and not (d.dictionary and d.dictionary.evidence):
                out.append(("error", d.id, "no word lists"))
            if d.kind == "regex" and not d.patterns:
                out.append(("error", d.id, "no pattern"))
            if ids.count(d.id) > 1:
                out.append(("error", d.id, "the id is given twice"))
        for p in self.profiles:
            out += [("error", p.id, f"detector {i} is not declared") for i in sorted(p.match.references() - set(ids))]
        return sorted(out)
