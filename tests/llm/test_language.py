import random
import zlib

import numpy as np

from tamis.llm import language
from tamis.llm.language import FOLDS, LET_PASS, PARTS_OF_A_BIT, ROOM, Familiarity, LanguageModel, family_of, features, fit_familiarity, fit_languages, identified, prose_features
from tamis.llm.queries import op7_language_id

WORDS = {"en": "the and thing house with water stone", "de": "der und nicht schön straße wasser haus", "fr": "le et été maison avec l'eau français", "es": "el y niño casa con agua mañana"}
SCHEMA = "doc_id bigint, text string, lang string, score int"


def rows(n):
    rng = random.Random(10)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=30)), lang, 1) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_and_odd_rows(spark):
    data = rows(240)
    odd = [(1000, None, "en", 1), (1001, "", "en", 1), (1002, "123 ... ² Ⅷ", "de", 1), (1003, "der und nicht schön " * 50_000, None, 1), (None, data[0][1], None, 1), (5, data[5][1], "xx", 1)]
    frame = spark.createDataFrame(data + odd, SCHEMA)
    got = identified(frame, fit_languages(frame)).collect()
    assert len(got) == len(data) + len(odd)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    for i, _, lang, _ in data:
        if i != 5:
            assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
            assert by_id[i]["lang_pred"] == lang
            assert 0 <= by_id[i]["score"] <= 1
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert by_id[None]["lang_pred"] == data[0][2] and not by_id[None]["held_out"]


def test_learns_from_nothing_held_out(spark):
    data = rows(120)
    swapped = [(i, t, "es" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in data]
    answers = lambda d: sorted(map(tuple, identified(spark.createDataFrame(d, SCHEMA), fit_languages(spark.createDataFrame(d, SCHEMA))).collect()))
    assert answers(data) == answers(swapped)


def test_without_model(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fit_languages(none) is None and identified(none, None).collect() == []
    unlabelled = spark.createDataFrame([(1, "some words", None, 1)], SCHEMA)
    assert [tuple(r) for r in identified(unlabelled, fit_languages(unlabelled)).collect()] == [(1, zlib.crc32(b"1") % 3 == 1, "und", 0.0)]
    one = LanguageModel.fit(features("a b c")[None, :], ["en"])
    assert one.predict(features("x y z")) == ("en", 1.0)
    assert family_of("pt-BR") == "romance" and family_of("qq") == "qq"


def test_features_in_pieces(monkeypatch):
    text = "straße und wasser " * 50
    whole = features(text)
    monkeypatch.setattr("tamis.llm.language.BYTES_AT_ONCE", 7)
    assert abs(features(text) - whole).max() < 1e-6


def test_accuracy_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    right = op7_language_id(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert right.where("lang = lang_pred").count() >= 0.99 * right.count()


def plain_familiarity(data):
    """Sums, median and limit over all rows that may be learnt from, one at a time."""
    learnt = [(lang, prose_features(text)) for i, text, lang, _ in data if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    learnt = [(lang, zlib.crc32(x.tobytes()) % FOLDS, x[:-1].astype(np.float64) ** 2, x[-1]) for lang, x in learnt if x[-1] > 0]
    bits, usual, strayed = {}, {}, []
    for lang in {r[0] for r in learnt}:
        mine = [r for r in learnt if r[0] == lang]
        sums = [sum((r[2] for r in mine if r[1] == f), np.zeros(len(mine[0][2]))) for f in range(FOLDS)]
        bits[lang] = Familiarity.bits_of(sum(sums))
        costs = [(r[2] @ Familiarity.bits_of(sum(sums) - sums[r[1]]), Familiarity.slack(r[3])) for r in mine]
        usual[lang] = sorted(c for c, _ in costs)[(len(costs) - 1) // 2]
        strayed += [(c - usual[lang]) / s for c, s in costs]
    return bits, usual, ROOM * sorted(strayed)[int(np.ceil(LET_PASS * len(strayed))) - 1]


def test_familiarity_counts_all_rows(spark, monkeypatch):
    """More rows than the machines are fitted on; the last of them, written otherwise, are too few for a sample to hold."""
    monkeypatch.setattr(language, "LEAST_LIMIT", 0.0)
    monkeypatch.setattr(language, "SUMS_HELD", 3)
    rng = random.Random(4)
    data = rows(9000) + [(9000 + i, " ".join("".join(rng.choices("qxzjkvw", k=5)) for _ in range(30)), "en", 1) for i in range(40)]
    frame = spark.createDataFrame(data + [(10**6, None, "en", 1), (10**6 + 2, "1 2", "en", 1), (None, data[0][1], None, 1)], SCHEMA)
    bits, usual, limit = plain_familiarity(data)
    first, again = (fit_familiarity(frame.repartition(n, "text")) for n in (3, 11))
    assert set(first.bits) == set(bits) and all(np.allclose(first.bits[k], bits[k], atol=1e-4) for k in bits)
    assert all(abs(first.usual[k] - usual[k]) <= 2 / PARTS_OF_A_BIT for k in usual)
    assert abs(first.limit - limit) <= 6 / PARTS_OF_A_BIT
    assert again.usual == first.usual and again.limit == first.limit and all((again.bits[k] == first.bits[k]).all() for k in bits)


def test_familiarity_of_few_rows(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert fit_familiarity(spark.createDataFrame([], SCHEMA)) is None
    one = fit_familiarity(spark.createDataFrame([(i, "the same words", "en", 1) for i in ids] + [(ids[0], "1 2", "de", 1)], SCHEMA))
    x = prose_features("the same words")
    assert one.limit == float("inf") and abs(one.usual["en"] - x[:-1] ** 2 @ one.bits["en"]) < 1e-3 and one.strangeness(x, "en") == 0 and one.usual["de"] == 0
