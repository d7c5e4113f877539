"""Hard negatives against plain loops: ties, repeats, windows at their edges, odd vectors, several blocks and wide numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import balltree
from tamis.llm.balltree import BallTree, hard_negatives


def plainly(rows, positives, k, scale=256):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, tuple(math.floor(scale * float(np.float32(x))) for x in v), label))
    good, out = sorted(set(good)), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, v, label in good:
        if i % 10 or (i, v, label) != min(x for x in good if x[0] == i):
            continue
        same = sorted((-dot(v, w), j) for j, w, other in good if j != i and other == label)[:positives]
        for p, j in same:
            p = -p
            wanted = sorted((-dot(v, w), n) for n, w, other in good if n != i and other != label and 30 * p <= 100 * dot(v, w) <= 90 * p)[:k]
            out += [(i, j, r, n, p, -s) for r, (s, n) in enumerate(wanted, 1)]
    return sorted(out)


def table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return frame.withColumns({"low": F.lit(1), "key": F.lit("x"), "_asks": F.lit(0), "block": F.lit(2)})


@pytest.mark.parametrize("blocks, leaf, asked", [(1, 4, 3), (3, 4, 1024), (None, 128, 1024)])
def test_against_plain_loops(spark, monkeypatch, blocks, leaf, asked):
    monkeypatch.setattr(balltree, "LEAF_ROWS", leaf)
    monkeypatch.setattr(balltree, "ASKED", asked)
    draw = random.Random(blocks)
    vector = lambda: [draw.choice([0.0, 0.5, 1.0, draw.uniform(-0.4, 1.2)]) for _ in range(4)]
    rows = [(i, vector(), draw.randrange(4) * 64) for i in range(120)]  # labels that share a bit of the trees' sets
    rows += rows[:7] + [(200 + i, rows[10][1], draw.randrange(4) * 64) for i in range(40)]  # repeats, and copies under other ids
    rows += [(300, [0.0] * 4, 0), (301, None, 1), (302, [float("nan")] * 4, 1), (303, [1.0, None, 0.0, 1.0], 1), (304, [1.0] * 4, None), (None, [1.0] * 4, 1), (305, [float("inf")] * 4, 1), (310, [1.0, 1.0], 64), (320, [-1.0] * 4, 64), (330, [], 7)]
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, positives=5, k=10, blocks=blocks).collect()
    assert sorted(map(tuple, got)) == plainly(rows, 5, 10) != []


def test_ids_with_several_vectors_and_no_rows(spark):
    rows = [(10, [1.0, 0.0], 1), (10, [0.0, 1.0], 1), (11, [1.0, 1.0], 1), (11, [2.0, 2.0], 1), (12, [0.5, 0.6], 2), (12, [0.5, 0.6], 2)]
    got = hard_negatives(table(spark, rows), F.col("vec_id") == 10).collect()
    assert sorted(map(tuple, got)) == plainly(rows, 5, 10)
    assert hard_negatives(table(spark, rows).limit(0), F.lit(True)).collect() == []
    assert hard_negatives(table(spark, [(10, None, 1)]), F.lit(True)).collect() == []


def test_wide_numbers(spark):
    rows = [(i, [float(1 << 21) + 97 * i * i, 3.0 * i], i % 2) for i in range(60)]  # products beyond 2 ** 53
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, low=0, high=100).collect()
    wanted = {(r[0], r[1]) for r in plainly([(i, v, 1) for i, v, _ in rows], 59, 1)} | {(0, 0)}
    assert all(r["positive_score"] > 1 << 53 for r in got) and wanted and got
    exact = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    assert all(r["negative_score"] == sum(a * b for a, b in zip(exact[r["anchor_id"]], exact[r["negative_id"]], strict=True)) for r in got)
    with pytest.raises(ArithmeticError):
        hard_negatives(table(spark, [(1, [1e30], 1)]), F.lit(True))


def test_bounds_hold_and_nodes_are_passed_over():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(16, 8)) * 400
    vectors = (centres[draw.integers(0, 16, 4000)] + draw.normal(size=(4000, 8)) * 20).astype(np.int64)
    tree = BallTree(vectors, np.arange(4000), draw.integers(0, 5, 4000))
    asks = vectors[:50].astype(np.float64)
    least, most = tree.bounds(asks, np.sqrt((asks**2).sum(axis=1)), slice(0, len(tree.spans)))
    scores, leaves = asks @ tree.points.T, 0
    for i, (a, b) in enumerate(tree.spans):
        assert (least[:, i] <= scores[:, a:b].min(axis=1)).all() and (scores[:, a:b].max(axis=1) <= most[:, i]).all()
        assert b - a <= balltree.LEAF_ROWS or 2 * i + 2 < len(tree.spans)
    kth = np.sort(scores, axis=1)[:, -10]
    leaves = [i for i in range((1 << tree.depth) - 1, len(tree.spans))]
    assert (most[:, leaves] >= kth[:, None]).mean() < 0.7
