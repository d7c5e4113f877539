import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from tamis.llm import tokencount as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = tc.WordTokenizer.from_file(PATH)


def texts():
    rng = random.Random(16)
    odd = [None, "", " ", "it's we'll I'D they're you've 'sun 'really ''s '''ll 'lx 'l", "<|endoftext|>a<|startoftext|> b<|END", "<|endoftext|><|endoftext|>", "ÀÉ é ΟΔΟΣ Σ İ ſ K ß ẞ", "日本語テキスト", "😀👩‍👩‍👧", "\x00\x1c\x1d\x85 　x᠎ y ﻿", "=" * 300, "ab" * 900, "naïve " * 200, "١٢٣ ½ Ⅷ ²", "a​b", "<|endoftext|>́x", "'", "x'", "don't'"]
    alphabet = "abcdefgh thean ionéüß.,!?'\n\t 0123456789ЖД漢'srvlemtd"
    return odd + ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(400)]


def wanted(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_against_the_library(monkeypatch):
    counter = tc.TokenCounter(OURS)
    assert counter.counts(texts()) == [wanted(t) for t in texts()]
    monkeypatch.setattr(tc, "RUN_CHARS", 50)
    monkeypatch.setattr(tc, "CHUNK", 3)
    monkeypatch.setattr(tc, "PIECES_KEPT", 100)
    monkeypatch.setattr(tc, "STATES_KEPT", 50)
    assert counter.counts(texts()) == [wanted(t) for t in texts()]


def test_every_code_point():
    """Of planes 0 to 3, and some beyond, where nothing is assigned but tags: each alone, three in a row, between letters, and before a mark, in texts of 256 words."""
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF and (i < 0x32000 or i % 61 == 0)]
    counter, texts = tc.TokenCounter(OURS), []
    for i in range(0, len(points), 64):
        block = points[i : i + 64]
        texts.append(" ".join(form for c in block for form in (c, c * 3, f"a{c}b", f"{c}\u0897\u0301")))
    want = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts) == want


@pytest.mark.parametrize("chunk", [1, 2, 5, 64])
def test_lexer(monkeypatch, chunk):
    monkeypatch.setattr(tc, "CHUNK", chunk)
    classes, pattern = tc._classes(), regex.compile(tc.SPLIT)
    for text in filter(None, texts()):
        if not set(text) & set("\x1c\x1d᠎"):  # the module's white space differs
            starts, ends = tc.lex(tc._code_points(text), classes)
            assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [m.span() for m in pattern.finditer(text)], text
    assert [len(x) for x in tc.lex(np.zeros(0, np.uint32), classes)] == [0, 0]


def test_real_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: wanted(r["text"]) for r in docs.collect()}
    got = tc.token_counts(docs, OURS).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)


def test_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "x y", 5), (2, "word " * 2048, 1), (3, "word " * 2049, 1), (4, "é", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(map(tuple, tc.token_counts(frame, OURS).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False), (2, 10240, 2048, False), (3, 10245, 2049, True), (4, 2, 1, False)], key=str)
    assert tc.token_counts(frame.limit(0), OURS).collect() == []


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        tc.WordTokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
