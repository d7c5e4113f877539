import random

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import toxicity as t
from tamis.llm.queries import op9_toxicity

DOCS, LABELS = "doc_id bigint, text string, toxic string", "doc_id bigint, quality int, toxic int"


def data(n=400):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = rng.choices([f"w{k}" for k in range(300)], k=40) + (rng.choices(["idiot", "scum", "grobzeug", "loser"], k=3) if bad else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_learns_and_takes_odd_rows(spark):
    docs, labels = data()
    odd = [(None, "idiot scum loser", "x"), (9001, None, "x"), (9002, "", "x"), (9003, "w1 w2 " * 100_000 + "grobzeug scum", "x"), (9003, "w1 w2", "x")]
    frame = spark.createDataFrame(docs + odd, DOCS)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (9001, 1, 1), (3, None, None)], LABELS)
    chain = t.fit_toxicity(frame, marks)
    got = t.toxicity(frame, chain).collect()
    assert len(got) == len(docs) + len(odd)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 9000:
            assert r["is_toxic"] == (r["doc_id"] % 4 == 0)
        assert all(0 <= r[f"p_{c}"] <= 1 for c in t.CATEGORIES)
    by = {(r["doc_id"], r["is_toxic"]) for r in got if r["doc_id"] is None or r["doc_id"] > 9000}
    assert by == {(None, True), (9001, False), (9002, False), (9003, True), (9003, False)}
    assert "grobzeug" in chain.places


def test_later_models_see_earlier_categories():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 3)) < 0.3).astype(np.float32)
    y = np.stack((x[:, 0], x[:, 0]), axis=1).astype(float)
    chain = t.Chain.fit(("a", "b"), ["f", "g", "h"], [np.flatnonzero(r).tolist() for r in x], y, np.arange(600) % 5, np.ones(600))
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][3] > 0
    assert chain.predict([0])[1] > 0.9 > 0.1 > chain.predict([1])[1]


def test_nothing_to_learn_from(spark):
    docs, labels = spark.createDataFrame([(1, "a b", "x")], DOCS), spark.createDataFrame([], LABELS)
    assert t.fit_toxicity(docs, labels) is None
    assert [tuple(r)[:2] for r in t.toxicity(docs, None).collect()] == [(1, False)]
    assert t.toxicity(docs.limit(0), None).collect() == []


def test_rows_outside_the_sample(spark, monkeypatch):
    """Fitted on at most half of the labelled rows, judged on those that were not drawn."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    kept = labels.where("doc_id % 2 = 0")
    got = t.toxicity(docs, t.fit_toxicity(docs, kept)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    hit, missed, wrong, clean = got.agg(F.count_if(F.expr("is_toxic and toxic = 1")), F.count_if(F.expr("not is_toxic and toxic = 1")), F.count_if(F.expr("is_toxic and toxic = 0")), F.count_if(F.expr("toxic = 0"))).first()
    assert hit >= 0.9 * (hit + missed) and wrong <= 0.01 * clean, (hit, missed, wrong, clean)
    flagged = op9_toxicity(spark, "/root/testdata/sf0.01")
    assert flagged.where("not is_toxic").count() == 0 and flagged.count() > 0


def test_kinds_are_groups_of_words_that_go_together():
    rng = random.Random(3)
    groups = [["idiot", "moron"], ["grobzeug", "abschaum"], ["ordure", "racaille"]]
    words = [w for g in groups for w in g] + ["house"]
    found, toxic, kind = [], [], []
    for i in range(300):
        g = rng.choices(range(3), [5, 3, 2])[0]
        toxic.append(float(i % 2))
        kind.append(g)
        found.append([words.index("house")] + ([words.index(w) for w in groups[g]] if i % 2 else []))
    got, groups_found = t.kinds_of(found, np.array(toxic), np.array([True] * 6 + [False]))
    assert groups_found == [{0, 1}, {2, 3}, {4, 5}]
    turned, _ = t.kinds_of(found, np.array(toxic), np.array([True] * 6 + [False]), like=[{4, 5}, {0, 1}, {3}])
    assert (turned == got[:, [2, 0, 1]]).all()
    for row, y, g in zip(got, toxic, kind, strict=True):
        assert row.tolist() == [float(y and g == k) for k in range(3)]
    assert not t.kinds_of(found, np.array(toxic), np.zeros(7, bool))[0].any()


def test_a_fold_answers_without_its_own_labels():
    """What a later model is trained on does not change with the labels of the rows that it is said of."""
    rng = np.random.default_rng(1)
    found = [np.flatnonzero(r).tolist() for r in rng.random((200, 4)) < 0.4]
    fold, y = np.arange(200) % 4, rng.integers(0, 2, (200, 2)).astype(float)
    seen = []

    def spied(x, target, *rest):
        seen.append(x.dense[:, :-1].copy())
        return fit(x, target, *rest)

    fit = t.fit_logistic
    other = y.copy()
    other[fold == 2] = 1 - other[fold == 2]
    within = lambda labels: {f: ({0, 1, 2, 3} - {f}, np.where((fold == f)[:, None], np.nan, labels)) for f in range(4)}
    answers = []
    for labels in (y, other):
        seen.clear()
        t.fit_logistic = spied
        try:
            t.Chain.fit(("a", "b"), list("wxyz"), found, labels, fold, np.ones(200), within(labels))
        finally:
            t.fit_logistic = fit
        answers.append(seen[-1][:, 0])  # the column of the first category, as the last model has it
    assert np.allclose(answers[0][fold == 2], answers[1][fold == 2]) and not np.allclose(answers[0], answers[1])


def test_scores_by_plain_loops(spark):
    """From words to probabilities without numpy, for all rows of the smallest table."""
    import math

    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    chain = t.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in t.toxicity(docs, chain).collect()}
    for r in docs.collect():
        logits = []
        for w in chain.weights:
            score = float(w[-1])
            for word, place in chain.places.items():
                score += float(w[place]) * (word in t.words_of(r["text"]))
            for k, earlier in enumerate(logits):
                score += float(w[len(chain.places) + k]) * max(-6.0, min(6.0, earlier)) / 6
            logits.append(score)
        for c, score in zip(t.CATEGORIES, logits, strict=True):
            assert abs(got[r["doc_id"]][f"p_{c}"] - 1 / (1 + math.exp(-score))) < 1e-6
