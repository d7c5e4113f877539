import random

import numpy as np
import xxhash

from tamis.llm import components, simhash
from tamis.llm.components import connected_components, joined_evenly
from tamis.llm.simhash import fingerprint, near_links, simhash_components


def plain_print(text):
    table = {i: i + 32 for i in range(65, 91)}
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "").translate(table)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "One", "a b c", "a b c d", "É b\x0bc\xa0d e", "x " * 20000, "a b c d e f"] + [" ".join(rng.choices(["the", "of", "An", "Öl", "x"], k=rng.randint(1, 60))) for _ in range(100)]:
        assert fingerprint(text) == plain_print(text), text


def test_every_near_pair_meets_at_an_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    y = x.copy()
    for i in range(300):
        for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    rows, home = simhash.anchors(x.view(np.int64))
    assert len(rows) == 3 * 300  # the code is perfect: one home in each block
    rows2, reached = simhash.anchors(y.view(np.int64), 2)
    for i in range(300):
        assert set(home[rows == i]) & set(reached[rows2 == i])


def test_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
            prints.add(p)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(25) for b in range(a)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    want = roots_of(sorted(map(signed, prints)), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "print bigint")
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    for hot in (8192, 20):
        links = near_links(frame, hot)
        found = {r["node"]: r["root"] for r in connected_components(links).collect()}
        got = {p: found.get(p, p) for p in want}
        assert len({(want[p], got[p]) for p in want}) == len(set(want.values())) == len(set(got.values()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base, "x", 0), (2, base, "x", 0), (3, base.upper(), "x", 0), (9, base + " more", "x", 0), (4, "", "x", 0), (7, None, "x", 0), (5, "quite another text", "x", 0), (5, "quite another text", "x", 0), (None, "other words here", "x", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, print string, component_id int")
    got = sorted(map(tuple, simhash_components(frame).collect()), key=str)
    texts = {(r[0]): plain_print(r[1]) for r in rows}
    want = roots_of(set(texts.values()), lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for i, p in texts.items():
        if i is not None:
            least[want[p]] = min(i, least.get(want[p], i))
    assert got == sorted(((r[0], f"{texts[r[0]]:016x}", least.get(want[texts[r[0]]])) for r in rows), key=str)
    assert simhash_components(frame.limit(0)).collect() == []


def test_hubs_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", 10)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 11), (3, 10), (4, 1)) for i in range(n)], "k int, v int")
    facts = spark.createDataFrame([(1, 500, "a"), (2, 11, "b"), (3, 10, "c"), (4, 1, "d"), (5, 0, "e")], "k int, n bigint, fact string")
    got = joined_evenly(rows, facts.where("n > 0"), "k", 522)
    assert got.columns == ["k", "v", "fact"]
    assert sorted(map(tuple, got.collect())) == sorted((r["k"], r["v"], "abcd"[r["k"] - 1]) for r in rows.collect())
    assert joined_evenly(rows.limit(0), facts.limit(0), "k", 0).collect() == []
    # a star, a chain and a clique, all larger than a hub
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 160)] + [(i, j) for i in range(200, 225) for j in range(i)][-300:]
    want = roots_of({x for link in links for x in link}, lambda a, b: (a, b) in links or (b, a) in links)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    groups = {}
    for node, root in want.items():
        groups.setdefault(root, []).append(node)
    assert all(found.get(x, x) == min(g) for g in groups.values() for x in g)
