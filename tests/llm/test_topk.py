import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import topk
from tamis.llm.topk import top_inner_products


def brute(rows, k=10):
    good = {(i, tuple(int(np.floor(float(np.float32(x)) * 1024)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in good:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("levels", [2, 24])
def test_against_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(topk, "LEVELS", levels)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "SEED_ROWS", 60)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(0, 900, 2)]
    same = [0.25, -0.5] * 4
    rows += [(2001 + i, same) for i in range(200)] + [(3000, same), (3000, same)]
    rows += [(100, [float("nan")] * 8), (200, [None] * 8), (400, None), (None, same), (500, [float("inf")] * 8), (7000, [0.0] * 8), (7001, [0.5])]
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id bigint, embedding array<float>, rank string, score int")
    got = top_inner_products(frame, F.col("vec_id") % 100 == 0, block_rows=150)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])]
    asks = F.col("vec_id") % 100 == 0
    assert sorted(map(tuple, top_inner_products(spark.createDataFrame(few, schema), asks).collect())) == brute(few)
    assert top_inner_products(spark.createDataFrame([], schema), asks).collect() == []


def test_bounds_prove(spark):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-300, 300, (500, 16))
    index = topk.ImpactIndex(vectors)
    for _ in range(50):
        query = rng.integers(-300, 300, 16)
        scores = vectors @ query
        reached = int(np.sort(scores)[-5])
        assert set(np.flatnonzero(scores >= reached)) <= set(index.members(query, reached))


def test_products_that_fit_no_long(spark):
    frame = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ArithmeticError):
        top_inner_products(frame, F.col("vec_id") == 0)
