import random

from tamis.llm import decontaminate as d


def sellers(pattern, text):
    """Least edit distance of the pattern to a part of the text, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        rng.choice([lambda: text.pop(i), lambda: text.insert(i, "z"), lambda: text.__setitem__(i, "q")])()
    return "".join(text)


def test_distance():
    rng = random.Random(4)
    for _ in range(300):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 60))) + edited(rng, pattern, min(3, len(pattern) - 1))
        masks = {c: sum(1 << i for i, x in enumerate(pattern) if x == c) for c in set(pattern)}
        assert d.least_distance(pattern, masks, text, 0, len(text))[0] == sellers(pattern, text)


def test_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("aeinrst", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(2, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "Short"), (None, prose(9)), (3, prose(9)), (4, prose(9)), (4, prose(9))]
    docs = [(None, prose(20), "x"), (1, None, "x"), (2, "", "x"), (3, "a SHORT one", "x"), (3, "a SHORT one", "x")]
    for i in range(10, 90):
        text = items[rng.randrange(25)][1]
        budget = d.pieces_of(len(d.normalised(text))) - 1
        inner = edited(rng, text, rng.choice([0, budget, budget, budget + 1, budget + 3]))
        docs.append((i, prose(30) + "\n\t" + inner.upper().replace(" ", " \n") + " " + prose(30), "x"))
    want = []
    for doc, text, _ in docs:
        least = {}
        for item, t in items:
            q = d.normalised(t)
            if item is not None and q and (n := sellers(q, d.normalised(text))) < d.pieces_of(len(q)):
                least[item] = min(n, least.get(item, n))
        want += [(doc, i, n) for i, n in least.items()]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"], r["distance"]) for r in d.benchmark_leaks(frame, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(want) > 40
    clean = [r["doc_id"] for r in d.without_leaks(frame, bench).collect()]
    assert sorted(clean, key=str) == sorted((r[0] for r in docs if r[0] not in {w[0] for w in want}), key=str)


def test_blocks_and_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number {i} has a text of its own, {i * 7919}") for i in range(6)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x item number 3 has a text of its own, 23757 y")], "doc_id bigint, text string")
    monkeypatch.setattr(d, "BLOCK_CHARS", 60)
    found = [tuple(r)[:3] for r in d.benchmark_leaks(docs, bench).collect()]
    assert (1, 3, 0) in found and all(n == 2 for _, i, n in found if i != 3)  # two edits turn one of these items into another
    assert d.benchmark_leaks(docs, bench.limit(0)).collect() == []
    assert d.benchmark_leaks(docs.limit(0), bench).collect() == []
    assert d.without_leaks(docs, bench.limit(0)).count() == 1


def test_short_items_stand_alone(spark):
    bench = spark.createDataFrame([(1, "yes"), (2, "is it so?")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "her eyes"), (2, "Yes."), (3, "is it so?"), (4, "this is it so? no")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.benchmark_leaks(docs, bench).collect()) == [(2, 1), (3, 2), (4, 2)]
    assert [r["item_id"] for r in docs.select(d.F.explode(d.leaks_column(d.F.col("text"), bench, least=4)).alias("x")).select("x.item_id").distinct().collect()] == [2]


def test_items_with_one_stem_and_items_in_several_blocks(spark, monkeypatch):
    import time

    stem = "which of the following statements about the harbour at dawn is the right one: "
    index = d.PieceIndex([(i, stem + f"answer {i * 7919 % 100_003} of them") for i in range(300)])
    text, start = ("some words before " + stem + "nothing that was asked. ") * 5, time.process_time()
    found = index.leaks(text)
    assert time.process_time() - start < 10 and found == index.leaks(text)
    monkeypatch.setattr(d, "BLOCK_CHARS", 60)
    twice = [(7, "item number 7 has a text of its own, 55433"), (8, "something else that is long enough"), (7, "item number 7 has a text of its own, 99999")]
    docs = spark.createDataFrame([(1, "x item number 7 has a text of its own, 99999 y")], "doc_id bigint, text string")
    assert [tuple(r)[:3] for r in d.benchmark_leaks(docs, spark.createDataFrame(twice, "item_id bigint, text string")).collect()] == [(1, 7, 0)]
