import base64
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from tamis.llm import bpe
from tamis.llm.queries import bpe_digest

PAIRS = bpe.BytePairs.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, PAIRS.ranks.splitlines())}, special_tokens={})


def texts():
    rng = random.Random(8)
    odd = [None, "", " ", "  \n\t x", "it's we'll I'D", "<|endoftext|>", "ÀÉ ß ſ K", "日本語テキスト", "😀👩‍👩‍👧", "\x00\x1c\x1d\x85 　x᠎ y", "é a", "=" * 300, "ab" * 500, "x" * 129, "naïve " * 200, "١٢٣ ½ Ⅷ", "a​b"]
    alphabet = "abcdefgh thean ionéüß.,!?'\n\t 0123456789ЖД漢"
    return odd + ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(150)]


def test_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 64)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 300)
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 500)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(1, "twice", "x"), (1, "twice", "x"), (None, "twice", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, bytes string")
    got = bpe.decoded(bpe.encoded(frame, PAIRS), PAIRS).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == LIBRARY.encode_ordinary(r["text"] or "")
        assert bytes(r["bytes"]).decode() == (r["text"] or "")


def encode(engine, *words):
    return [i for sizes, ids in engine.encode(pa.array(words)) for i in ids.tolist()]


def test_windows_and_keyed_recursion(monkeypatch):
    """Long words in overlapping windows; periodic ones, whose windows do not agree, by the keyed recursion in parts."""
    rng, alphabet = random.Random(3), "thequickbrownfoxjumpsoverlazydog"
    words = ["".join(rng.choices(alphabet, k=5000)), "x" + "=" * 3000, "zabc" * 900, "a" * 2049, "ACGT" * 10 + "".join(rng.choices("ACGT", k=3000)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(900)), "".join(chr(rng.randint(0xE01, 0xE3A)) for _ in range(900))]
    wanted = [LIBRARY.encode_ordinary(w) for w in words]
    for piece, stride, keyed in ((128, 64, 1 << 16), (64, 32, 700), (4, 2, 512)):
        monkeypatch.setattr(bpe, "PIECE", piece)
        monkeypatch.setattr(bpe, "STRIDE", stride)
        monkeypatch.setattr(bpe, "KEYED_BYTES", keyed)
        engine = bpe.Engine(PAIRS)
        for word, want in zip(words, wanted, strict=True):
            assert encode(engine, word) == want


def test_memory_is_bounded():
    """In an engine of 250 MB: runs of CJK, words of 127 bytes, and one word of a megabyte."""
    rng = random.Random(5)
    runs = "。".join("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(40)) for _ in range(16_000))
    assert encode(bpe.Engine(PAIRS), runs) == LIBRARY.encode_ordinary(runs)
    words = " ".join("".join(rng.choices("etaoinshrdlu", k=127)) for _ in range(4_000))
    assert encode(bpe.Engine(PAIRS), words) == LIBRARY.encode_ordinary(words)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    assert encode(bpe.Engine(PAIRS), word) == LIBRARY.encode_ordinary(word)
    assert encode(bpe.Engine(PAIRS), "=" * (1 << 17)) == LIBRARY.encode_ordinary("=" * (1 << 17))


def test_unknown_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [5, 9_999_999]), (2, None), (3, []), (4, [0, 0])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["bytes"] for r in bpe.decoded(frame, PAIRS).collect()}
    assert got[1] is None and got[2] is None and got[3] == b"" and bytes(got[4]) == LIBRARY.decode_bytes([0, 0])
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe_digest(none, PAIRS).collect() == []


def test_digest(spark):
    import hashlib

    rows = [(i, t) for i, t in enumerate(texts())]
    for r in bpe_digest(spark.createDataFrame(rows, "doc_id bigint, text string"), PAIRS).collect():
        ids, raw = LIBRARY.encode_ordinary(rows[r["doc_id"]][1] or ""), (rows[r["doc_id"]][1] or "").encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
