import hashlib
import zlib
from collections import defaultdict

import pytest

from tamis.llm.sharding import shard_records

SCHEMA = "doc_id bigint, text string, shard string, size int"


def brute(rows, shards):
    key = lambda r: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), -(2**63) if r[0] is None else r[0])
    size = lambda r: len((r[1] or "").encode()) + 1
    total, at, seen, out = sum(map(size, rows)), 0, defaultdict(int), []
    for r in sorted(rows, key=key):
        n = size(r)
        s = min((2 * at + n) * shards // (2 * total), shards - 1)
        out.append((r[0], n, zlib.crc32((r[1] or "").encode()), "bytes", s, seen[s], None))
        at, seen[s] = at + n, seen[s] + 1
    return out


@pytest.mark.parametrize("shards", [3, 16])
def test_against_brute_force(spark, shards):
    rows = [(i, "wörd " * (i % 37), "x", 1) for i in range(600)] + [(None, None, None, None), (5, "", "x", 1), (5, "", "x", 1)]
    rows += [(1000 + i, "one hot text that many rows share", "x", 1) for i in range(700)] + [(9000, "long " * 4000, "x", 1)]
    got = shard_records(spark.createDataFrame(rows, SCHEMA), shards)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    order = lambda x: [tuple((v is None, v) for v in r) for r in x]
    assert sorted(order(map(tuple, got.collect()))) == sorted(order(brute(rows, shards)))


def test_empty_and_carried(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shard_records(empty).collect() == []
    rows = [(i, str(i), "x", 1) for i in range(50)]
    got = shard_records(spark.createDataFrame(rows, SCHEMA), 4, carry=("text",)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(i, str(i)) for i in range(50)]
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
