"""Long word lists: as sets and as tables they say what short ones say as literals, and the plan does not grow with them."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tamis import queries
from tamis.operators import detect, lexicons, names
from tamis.operators.lexicons import evidence_table, listed_of, with_listed
from tamis.plans.default_rules import DEFAULT_RULES as RULES

NAME = RULES.detector("person_name")


def longer(n):
    """The rules with n given names and 2 n surnames more, of which some are common words."""
    word = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    words = NAME.dictionary
    lists = replace(words, given_names=words.given_names | {word(i) for i in range(n)}, surnames=words.surnames | {word(i) for i in range(n, 3 * n)}, common_words=words.common_words | {word(i) for i in range(0, 3 * n, 10)})
    return replace(RULES, detectors=tuple(replace(d, dictionary=lists) if d is NAME else d for d in RULES.detectors)), [word(i) for i in range(3 * n)]


def texts(spark, words):
    draw = random.Random(6)
    some = [w.capitalize() for w in words] + ["Dr", "Smith", "John", "the", "a", ".", ",", "Of", "École"]
    rows = [(i, " ".join(draw.choices(some, k=draw.randint(0, 30)))) for i in range(80)]
    return spark.createDataFrame([*rows, rows[3], (None, None), (None, "John Smith")], "doc_id int, text string")


def test_sets_and_tables_and_literals_agree(spark, monkeypatch):
    rules, words = longer(200)
    frame, d, c = texts(spark, words), rules.detector("person_name"), RULES.confidence
    assert len(d.dictionary.evidence) > lexicons.LITERAL_WORDS
    rows = lambda df: sorted(map(str, df.collect()))
    table = spark.createDataFrame([(w,) for w in d.dictionary.evidence], "word string")
    by_set, by_table, found = rows(names.name_spans(frame, d, c)), rows(names.name_spans(frame, d, c, evidence=table)), rows(detect.findings_long(frame, rules))
    monkeypatch.setattr(lexicons, "LITERAL_WORDS", 1 << 30)
    assert by_set == by_table == rows(names.name_spans(frame, d, c)) and len(by_set) > 50
    detect._compiled.cache_clear()
    assert found == rows(detect.findings_long(frame, rules))
    detect._compiled.cache_clear()


def test_plans_do_not_grow_with_lists(spark):
    sizes = []
    for n in (1000, 5000):  # 5,000 given names and 10,000 surnames
        rules, words = longer(n)
        frame = texts(spark, words[:50])
        plan = names.name_spans(frame, rules.detector("person_name"), RULES.confidence)._jdf.queryExecution().optimizedPlan()
        sizes.append(len(plan.toString()))
    assert abs(sizes[0] - sizes[1]) < 100


def test_tables_of_words(spark):
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = evidence_table(words("Ann", " bob ", None, "", "may"), words("BOB", "lee"), words("may", None))
    assert sorted(r["word"] for r in got.collect()) == ["ann", "bob", "lee"]
    frame = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c"]), (4, ["c"]), (5, ["a", None])], "id int, w array<string>")
    got = sorted((r["id"], r["out"] if r["out"] is None else sorted(r["out"])) for r in with_listed(frame, F.col("w"), words("a", "b", "b", None), "out").collect())
    assert got == [(1, ["a", "b"]), (2, []), (3, None), (4, []), (4, []), (5, ["a"])]
    assert [r[0] for r in frame.orderBy("id").limit(3).select(listed_of(F.col("w"), ("a", "x"))).collect()] == [["a", "a"], [], None]


def test_a_list_too_long_for_a_set(spark, monkeypatch):
    monkeypatch.setattr(lexicons, "SET_BYTES", 3)
    with pytest.raises(ValueError, match="table"):
        listed_of(F.array(F.lit("a")), ("aa", "bb"))


def nodes(plan):
    """A plan's nodes, each with the names of the columns that it gets."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    yield plan.nodeName(), {x.output().apply(i).name() for x in below for i in range(x.output().size())}
    for x in below:
        yield from nodes(x)


def test_no_text_is_joined_with_a_table(spark):
    """Moving texts, and the words of each beside every one of them, took disk of seven times the input."""
    frame = spark.createDataFrame([(1, "John Smith")], "doc_id int, text string")
    table = spark.createDataFrame([("john",)], "word string")
    plan = names.name_spans(frame, NAME, RULES.confidence, evidence=table)._jdf.queryExecution().optimizedPlan()
    moved = [columns for name, columns in nodes(plan) if name in ("Join", "Aggregate")]
    assert len(moved) >= 2 and not any(columns & {"text", "_text", "_words", "_spans", "_bytes"} for columns in moved)


def test_spans_that_are_alike_stay_apart(spark):
    texts = ["John John Smith and Dr Zyx, of patient Ann", "Dr Zyx Qux Smith", "Dr Zyx Qux Smith then Mary", "Dr John", "Mr. Dr, Zyx", "", None]
    rows = [(i, t) for t in texts for i in (1, 1, 2, None, None)] + [(3, texts[1])] * 40
    frame, c = spark.createDataFrame(rows, "doc_id int, text string").repartition(5), RULES.confidence
    table = spark.createDataFrame([(w,) for w in [*NAME.dictionary.evidence, "john", None]], "word string")
    by_list, by_table = (sorted(map(str, names.name_spans(frame, NAME, c, evidence=e).collect())) for e in (None, table))
    assert by_list == by_table and len(by_list) > 50 and any("evidence=0" in x for x in by_list) and any("evidence=3" in x for x in by_list)


def test_words_of_the_corpus_are_counted_once(spark):
    frame = queries.QUERIES["corpus_evidence"](spark, "/root/testdata/sf0.001")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("[a-z]{2,}") == 1


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 500])
def test_places_of_many_spans(spark, n):
    """They are placed in chunks of items."""
    parts = ["é, John" if i % 3 else "a b. Éx John Smith" for i in range(n)]
    text = " x! ".join(parts)
    frame = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(r["start"], r["span"]) for r in names.name_spans(frame, NAME, RULES.confidence).orderBy("start").collect()]
    assert got == [(len(text[: m.start()].encode()), m[0]) for m in re.finditer("(?:Éx )?John(?: Smith)?", text)]
