"""Searches with places, parts around digits, and sets of literals, against plain searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tamis.functions import re2
from tamis.operators import detect, places
from tamis.operators.literals import literals_in
from tamis.plans.rules import Detector, RuleSet

PATTERNS = [r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2}){1,3}\b", r"[0-9]{2,4}[a-z]?", r"\B[0-9]-", r"(?i)k\d|\d{2}é", r"[^ ]x[1-3]", r"[a-z]+@[a-z]+", r"9\.{0,5}"]


def texts():
    draw = random.Random(4)
    bits = ["AB12", "1", "22", "x2", " ", " ", "é", "a", "B", "-", "@b", "😀", "￾", "\n", "9...", "K3", "word " * 9, "é" * 30]
    return [None, "", "1", "￾1￾"] + ["".join(draw.choices(bits, k=draw.randint(1, 60))) for _ in range(300)]


def plainly(pattern, text):
    out = []
    for m in re.finditer(re2.to_java(pattern).replace("(?iu)", "(?i)"), text):
        out.append((len(text[: m.start()].encode()), m.group()))
    return out


@pytest.mark.parametrize("most", [2048, 1])
def test_matches_and_their_places(spark, monkeypatch, most):
    monkeypatch.setattr(places, "MOST_STRETCHES", most)
    rules = RuleSet(tuple(Detector(f"d{i}", 60, (p,)) for i, p in enumerate(PATTERNS)), ())
    assert [re2.reach(p) is not None for p in PATTERNS] == [True, True, True, True, True, False, True]
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in detect.matches_long(frame, rules).orderBy("ord").collect():
        got.setdefault((r["doc_id"], r["detector"]), []).append((r["start"], r["value"]))
    for i, text in rows:
        readable = (text or "").replace("￾", "�")
        for k, p in enumerate(PATTERNS):
            digit = re2.reach(p) is None or re.search("[0-9]", readable)
            assert got.get((i, f"d{k}"), []) == (plainly(p, readable) if digit else []), (text, p)
    limited = detect.matches_long(frame, rules, limit=2).groupBy("doc_id", "detector").count().collect()
    assert {(r["doc_id"], r["detector"]): r["count"] for r in limited} == {k: min(2, len(v)) for k, v in got.items()}


def test_reach():
    assert [re2.reach(p) for p in ("a{2}[0-9]", "(?:ab|c1)", r"x?\d{2,3}", r"\d+", "^1", "[0-9-]1", "[^0-9]", r"\b(?:[1-5]a|22)\b", r"\pN")] == [3, None, 4, None, None, 2, None, 2, None]


def test_literals(spark):
    words = ["a", "ab", "b", "é", "ab", "", "zz", "bab"]
    frame = spark.createDataFrame([(t,) for t in ("abab", "xéx", "", "q", None, "zz" * 1000)], "t string")
    got = [r[0] for r in frame.select(literals_in(F.col("t"), words)).collect()]
    want = [None if t is None else [w for w in dict.fromkeys(words) if w in t] for t in ("abab", "xéx", "", "q", None, "zz" * 1000)]
    assert [g if g is None else sorted(g) for g in got] == [w if w is None else sorted(w) for w in want]
    assert [r[0] for r in frame.select(literals_in(F.col("t"), [])).collect()] == [[], [], [], [], None, []]


def test_plans_stay_small(spark):
    """The whole way from files to verdicts is planned within a bound, whatever the columns are read by."""
    import time

    from tamis.plans.default_rules import DEFAULT_RULES as RULES
    from tamis.sources import files

    frame = files.from_memory(spark, [("a.txt", b"text")])
    files.inspect_files(frame, RULES)
    start = time.perf_counter()
    found = files.inspect_files(frame, RULES).groupBy("verdict").count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - start < 10 and len(plan.splitlines()) < 80, plan
