"""Collocations against plain loops over texts with repeats, breaks, odd white space and several languages."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamis.llm import collocations as module
from tamis.llm.collocations import collocations


def plainly(rows, max_n, least, absorbed, top):
    upper = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    longer = [(lang, p, a) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    for lang, p, a in longer:
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(x == lang and len(q) > len(p) and 100 * b >= absorbed * a and inside(q) for x, q, b in longer):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, cut, left, right = min(cuts)
        out.append((lang, " ".join(p), len(p), cut, a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[8], -r[4], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


def rows_of(seed):
    draw = random.Random(seed)
    words = ["a", "B", "é", " x", "c-d", "ß", "'", "\x1c"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", "  ", "\t", " ", ".", "\n", " , ", "\r"]) for _ in range(draw.randrange(60)))
    rows = [(draw.choice(["en", "en", "de", None, "und"]), text()) for _ in range(60)]
    return rows + rows[:5] + [("en", None), ("en", ""), (None, "..., \n"), ("fr", "one")]


@pytest.mark.parametrize("chunk, bits", [(1 << 22, 1 << 25), (40, 1 << 10)])
def test_against_plain_loops(spark, monkeypatch, chunk, bits):
    monkeypatch.setattr(module, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(module, "FILTER_BITS", bits)  # a bitmap with room for few says yes too often, no more
    rows = rows_of(bits)
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({"f": F.lit(1), "phrase": F.lit("x")})
    for max_n, least, absorbed, top in ((4, 3, 80, 2000), (4, 2, 60, 7), (3, 2, 100, 50), (2, 4, 80, 3)):
        got = collocations(frame.repartition(3), max_n, least, absorbed, top).collect()
        assert sorted(map(tuple, got)) == plainly(rows, max_n, least, absorbed, top)
    assert collocations(frame.limit(0)).collect() == []


def test_bitmap_has_all_it_was_given(spark):
    rows = [("en", f"w{i}") for i in range(3000)] + [("", "é")]
    frame = spark.createDataFrame(rows, "lang string, phrase string").select(F.xxhash64("lang", "phrase").alias("hash"))
    bits = module.bits_of(frame, 1 << 17)
    names = [p.encode() for _, p in rows[:-1]]
    assert module.holds(bits, module.Words(names, "en").hashes).all() and module.holds(bits, module.Words(["é".encode()], "").hashes).all()
    assert module.holds(bits, module.Words(names, "de").hashes).mean() < 0.1


def test_counts_beyond_64_bits(spark):
    a = (1 << 62) - 1
    row = spark.sql(f"SELECT cast({a} AS bigint) AS a, cast({a} AS bigint) AS l, cast({a} AS bigint) AS r").select(module.exact_score().alias("s")).first()
    assert row["s"] == 1000000


def test_a_long_text(spark):
    frame = spark.createDataFrame([("en", "one two three four " * 250_000)], "lang string, text string")
    got = {r["phrase"]: (r["a"], r["n"]) for r in collocations(frame).collect()}
    assert got["one two three four"] == (250_000, 1_000_000)
