"""The pipeline against plain Python on a small table: what goes, what stays, and what becomes of it."""

import hashlib
import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as cp  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_bpe import LIBRARY
from test_simhash import plain_print, roots_of

from tamis.llm.decontaminate import normalised
from tamis.llm.secrets import redacted
from tamis.llm.simhash import one_of_each

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {"en": "the and thing house with water stone", "de": "der und nicht schön straße wasser haus"}


def small_corpus(tmp_path, spark):
    rng = random.Random(18)
    rows = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choices(WORDS[lang].split(), k=80)) + f" number{i} of{i * 7} all{i * 3}"
        rows.append((i, text, lang, "s", len(text)))
    item = "a passage of the benchmark that no document should ever hold in its text"
    rows += [(300 + i, rows[3][1], "en", "t", 1) for i in range(30)]
    rows += [(400, "der " + item + " und", "de", "s", 1), (401, "no letters: 1", "en", "s", 1), (402, "123 456", "en", "s", 1), (403, None, "en", "s", 1), (404, "", "de", "s", 1)]
    rows += [(500, 'the house with token = "' + "0af3" * 10 + '" and water stone thing', "en", "s", 1)] + [(None, "the water and the stone with a house of no number", "en", "s", 1)] * 2
    rows += [(600, "der schön haus straße wasser und nicht zweimal", "de", "s", 1)] * 3
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, item


def deduped(rows):
    """One row of each component, by every pair of fingerprints."""
    roots = roots_of({plain_print(r[1]) for r in rows}, lambda a, b: bin(a ^ b).count("1") <= 4)
    groups = {}
    for r in set(rows):
        groups.setdefault(roots[plain_print(r[1])], []).append(r)
    return {g: {r for r in rs if (r[0] is None, r[0]) == min((x[0] is None, x[0] or 0) for x in rs) or r[0] == min((x[0] for x in rs if x[0] is not None), default=None)} for g, rs in groups.items()}


def test_near_dedup_keeps_one_of_each(spark, tmp_path):
    rows, _ = small_corpus(tmp_path, spark)
    got = [tuple(r) for r in one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = deduped(rows)
    assert len(got) == len(want) and all(any(g in rs for rs in want.values()) for g in got)
    assert one_of_each(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stages(spark, tmp_path):
    rows, item = small_corpus(tmp_path, spark)
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    results = []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        results.append([tuple(r) for r in docs.collect()])
        if i < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    language, dedup, clean, secret, tokens = results
    assert sorted(language, key=str) == sorted((r for r in rows if r[0] not in (402, 403, 404)), key=str)
    assert len(dedup) == len(deduped(language)) and {r[0] for r in dedup} & set(range(300, 330)) == set()
    assert clean and sorted(clean, key=str) == sorted((r for r in dedup if item not in normalised(r[1])), key=str) and len(clean) == len(dedup) - 1
    assert sorted(secret, key=str) == sorted(((r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1]))) for r in clean), key=str)
    assert "<SECRET>" in next(r[1] for r in secret if r[0] == 500)
    texts = {r[0]: r[1] for r in secret}
    assert len(tokens) == len(secret)
    for doc, _, _, n, ids, same in tokens:
        assert ids == LIBRARY.encode_ordinary(texts[doc]) and n == len(ids) and same
    digest = lambda out: sorted(hashlib.sha256(str(tuple(r)).encode()).hexdigest() for r in out)
    assert digest(cp.run(spark, str(tmp_path)).collect()) == digest(tokens)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []



def test_extra_columns_with_clashing_names(spark, tmp_path):
    rows, _ = small_corpus(tmp_path, spark)
    frame = spark.createDataFrame([(*r, f"a{i}", i, "x", 0) for i, r in enumerate(rows)], SCHEMA + ", _answer string, _digest int, print string, ids int")
    kept = cp.language_id(spark, frame, str(tmp_path))
    once = one_of_each(kept)
    assert kept.columns == once.columns == frame.columns
    given = set(map(tuple, frame.collect()))
    assert set(map(tuple, once.collect())) < set(map(tuple, kept.collect())) < given
    secret = cp.secret_scan(spark, cp.decontamination(spark, once, str(tmp_path)), str(tmp_path))
    assert secret.columns == frame.columns
    assert cp.byte_bpe(spark, secret, str(tmp_path)).where("not round_trip").count() == 0


def test_language_stage_rejects_what_was_not_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(31)
    gibberish = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(80))
    polish = "Następnego ranka stary rybak wypłynął łodzią na wyspę, gdzie czekali na niego przyjaciele, aby świętować urodziny jego córki."
    finnish = "Seuraavana aamuna vanha kalastaja lähti veneellään saarelle, jossa ystävät odottivat häntä juhlimaan hänen tyttärensä syntymäpäivää."
    russian = "На следующее утро старый рыбак вышел на лодке к острову, где его ждали друзья, чтобы отпраздновать день рождения дочери."
    strange = [(-i, t, None, "s", len(t)) for i, t in enumerate((gibberish, polish, finnish, russian), 1)]
    short = [(-10, "The house and the water.", None, "s", 24), (-11, "Der und die das.", None, "s", 16)]
    got = {r[0] for r in cp.language_id(spark, docs.union(spark.createDataFrame(strange + short, docs.schema)), "").select("doc_id").collect()}
    assert not got & {-1, -2, -3, -4} and {-10, -11} <= got
    few = docs.where("lang = 'en'").union(spark.createDataFrame(strange + short[:1], docs.schema))  # one language, so a score of 1
    one = {r[0] for r in cp.language_id(spark, few, "").select("doc_id").collect()}
    assert not one & {-1, -2, -3, -4} and -10 in one
    clean = docs.where("text not rlike '[0-9#$%&*|!]'")
    assert clean.where(~F.col("doc_id").isin(list(got))).count() == 0
    assert len(got) >= 0.995 * docs.count()
