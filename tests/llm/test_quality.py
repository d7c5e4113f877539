import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import quality as q
from tamis.llm.queries import op10_quality

DOCS, LABELS = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int", "doc_id bigint, quality int, toxic int"


def data(n=500):
    rng = random.Random(14)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = rng.choices(["river", "stone", "water", "house", "field", "light"], k=60)
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!! ###" for w in words)
        docs.append((i, text + f" {i}", "en", "good.org" if good == (rng.random() < 0.9) else "spam.biz", len(text), 7))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def test_scores_all_rows(spark):
    docs, labels = data()
    odd = [(None, None, None, None, None, None), (9000, "", "en", "good.org", 0, 1), (9001, "river " * 200_000, "en", "x", 1, 1), (9001, "river stone", "en", "x", 1, 1)]
    frame, marks = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (4, None, 0)], LABELS)
    model = q.fit_quality(frame, marks)
    assert sum(model.given) > 0  # each view took over what the other was sure of
    got = q.quality(frame, model).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r[c] <= 1 for r in got for c in ("quality", "content_score", "metadata_score"))
    right = [r["keep"] == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 9000]
    assert sum(right) >= 0.98 * len(right)


def test_nothing_to_learn_from(spark):
    docs, labels = spark.createDataFrame(data(4)[0], DOCS), spark.createDataFrame([], LABELS)
    assert q.fit_quality(docs, labels) is None
    assert {(r["quality"], r["keep"]) for r in q.quality(docs, None).collect()} == {(0.5, True)}
    assert q.quality(docs.limit(0), None).collect() == []
    assert q.quality(docs.select("doc_id", "text"), None).count() == 4


def test_features():
    assert not np.isnan(q.text_features(None)).any() and not np.isnan(q.text_features("\n\n ")).any()
    assert q.metadata_features(["a=b"]).sum() == 1


def test_rows_that_were_not_learnt_from(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    kept = labels.where("doc_id % 2 = 0")
    got = q.quality(docs, q.fit_quality(docs, kept)).withColumnRenamed("quality", "score").join(labels.where("doc_id % 2 = 1"), "doc_id").select("score", "keep", "quality").toPandas()
    pos, neg = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    auc = np.mean(pos[:, None] > neg[None, :])
    assert auc >= 0.95 and got.keep[got.quality == 1].mean() >= 0.97, (auc, got.keep[got.quality == 1].mean(), got.keep[got.quality == 0].mean())


@pytest.mark.parametrize("size", ["0.001"])
def test_query(spark, size):
    assert op10_quality(spark, f"/root/testdata/sf{size}").where(F.col("quality").isNull()).count() == 0


def test_surest_rows_of_all_come_from_each_source(spark):
    docs, labels = data()
    hot = [(i, "River stone water house field light. " * 3 + str(i % 900), "en", "hot.org", 99, 1) for i in range(10_000, 19_000)]
    rare = [(20_000, "River stone water house, field and light. " * 3, "en", "rare.net", 99, 1)]
    frame, marks = spark.createDataFrame(docs + hot + rare, DOCS), spark.createDataFrame(labels, LABELS)
    meta = q.metadata_features(["source=rare.net"])
    assert abs(q.fit_quality(frame, marks).views[1][:-1] @ meta) > 1e-4  # no label says anything about this source


def test_surest_rows_by_hand(spark, monkeypatch):
    monkeypatch.setattr(q, "HANDED_OVER", 6)
    import random as r

    rng = r.Random(5)
    labelled = {4, 5, 74}
    rows = [(i % 70, q.text_features(f"{i % 70} " + "word " * rng.randint(1, 40)).astype("float16").tobytes(), [f"source=s{i % 3}"]) for i in range(300)]
    pool = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, h bigint, a binary, meta array<string>").repartition(5)
    known = spark.createDataFrame([(i,) for i in labelled], "id bigint")
    rows = [r for i, r in enumerate(rows) if i not in labelled]
    views = [np.random.default_rng(1).normal(size=q.SHAPES + q.TEXT_WIDTH + 1) * 4, np.random.default_rng(2).normal(size=q.META_WIDTH + 1)]
    taken = [{1, 2, 3}, set(range(0, 70, 7))]
    got = {(v, y): set(h) for v, y, h, _ in q._surest(pool, known)(views, taken)}
    for y in (0, 1):
        best = {}
        for h, a, meta in rows:
            p = float(q.sigmoid(q.scores(np.frombuffer(a, np.float16).astype(np.float32), views[0])))
            s = p if y else 1 - p
            if s >= q.SURE and h not in taken[1]:
                best[h] = min(best.get(h, (0, meta)), (-s, meta))
        want = {h for g in range(3) for h in sorted((h for h in best if best[h][1] == [f"source=s{g}"]), key=lambda h: (best[h][0], h))[:2]}
        assert got.get((0, y), set()) == want
