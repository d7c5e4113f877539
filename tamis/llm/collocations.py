"""Phrases that stand together more often than their parts: counts of 1- to n-grams by language, scored and ranked.

Texts are exploded into n-gram rows (lang, phrase, f), which Spark hash-aggregates by language and phrase; the counts of
both parts of each cut are joined to a phrase, scores are made in Decimal, phrases that a one-word extension accounts for
go by an anti-join, and a window ranks the rest.

A phrase of `least` occurrences has only parts of as many. So after the words, only pairs of words that may be frequent are
looked at, longer n-grams only where all their pairs may be, and in the end only what may be frequent itself: bitmaps of a
fixed size say so. They err on the side of too many, which the counts then settle. The bitmaps of pairs and of longer ones
come from counts by a hash, so that the many rare ones are shuffled as numbers and never as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stable

#: Bits of the bitmap of frequent parts, and bytes of text that a task explodes at a time.
FILTER_BITS = 1 << 25
CHUNK_BYTES = 2 << 20
#: Tasks among which the phrases of a language are ranked first.
RANK_PARTS = 64
_BREAKS, _MARK = b".,;:!?\n\x0b\x0c\r", b"."
_TO_MARK = bytes.maketrans(_BREAKS, _MARK * len(_BREAKS))


def _chunks(texts: Iterator[bytes]):
    """The tokens of texts joined by a mark, CHUNK_BYTES or little more at a time; a longer text is cut at marks where it
    has any."""
    held, size = [], 0

    def tokens(parts: list[bytes]) -> list[bytes]:
        return _MARK.join(parts).replace(_MARK, b" . ").split()

    for text in texts:
        text = text.lower().translate(_TO_MARK)  # of bytes: A-Z alone
        start = 0
        while len(text) - start > CHUNK_BYTES and (cut := text.find(_MARK, start + CHUNK_BYTES)) >= 0:
            yield tokens([text[start:cut]])
            start = cut + 1
        held.append(text[start:])
        size += len(text) - start
        if size >= CHUNK_BYTES:
            yield tokens(held)
            held, size = [], 0
    if held:
        yield tokens(held)


class Words:
    """The words of a chunk as numbers: `names` by number, `ids` in their order, the mark among them, and what they hash to
    in a language, as Spark's xxhash64 of (lang, phrase) does."""

    def __init__(self, tokens: list[bytes], lang: str):
        coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
        self.names, self.ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names), np.uint64, len(self.names))
        self.solid = np.array([w != _MARK for w in self.names], bool)

    def gram_hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """32 bits for the n words from each place of `at` on."""
        x = self.hashes[self.ids[at]] + np.uint64(n)
        for k in range(1, n):
            x = x * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.ids[at + k]]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = hashes.astype(np.int64) & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bits_of(hashes: DataFrame, size: int | None = None) -> np.ndarray:
    """The bitmap of a column `hash`. It is put together in Spark; `size` bits, a power of two, reach the driver, whatever the
    rows."""
    size = size or FILTER_BITS
    at = F.col("hash").bitwiseAND(F.lit(size - 1)) + 1  # the bitmap functions count from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in parts.toArrow().to_pylist():
        part = np.frombuffer(row["bits"], np.uint8)
        start = (row["bucket"] - 1) * len(part)
        out[start : start + len(part)] = part[: len(out) - start]
    return out


def _pairs(words: Words, bits: np.ndarray) -> np.ndarray:
    """At which places a pair of words begins that `bits` both has."""
    good = words.solid & holds(bits, words.hashes)
    return np.flatnonzero(good[words.ids[:-1]] & good[words.ids[1:]])


def _places(words: Words, bits: np.ndarray, pair_bits: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For n from 2 to max_n: n, and the places where an n-gram begins all pairs of which the bitmaps have."""
    at = _pairs(words, bits)
    at = at[holds(pair_bits, words.gram_hashes(at, 2))]
    pairs = np.zeros(len(words.ids) + max_n, bool)
    pairs[at] = True
    for n in range(2, max_n + 1):
        if n > 2:  # one word more, where a pair begins at the last one
            at = at[pairs[at + n - 2]]
        yield n, at


def word_counts(words: Words) -> tuple[list, np.ndarray]:
    count = np.bincount(words.ids, minlength=len(words.names))
    at = np.flatnonzero(words.solid)
    return [words.names[i] for i in at.tolist()], count[at]


def pair_buckets(words: Words, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of pairs of words that `bits` has, and how often each stands there."""
    return np.unique(words.gram_hashes(_pairs(words, bits), 2), return_counts=True)


def longer_buckets(words: Words, bits: np.ndarray, pair_bits: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of 3- to max_n-grams, all pairs of which the bitmaps have."""
    hashes = [words.gram_hashes(at, n) for n, at in _places(words, bits, pair_bits, max_n) if n > 2]
    return np.unique(np.concatenate([np.zeros(0, np.int64), *hashes]), return_counts=True)


def gram_counts(words: Words, bits: np.ndarray, pair_bits: np.ndarray, longer_bits: np.ndarray, max_n: int) -> tuple[list, np.ndarray]:
    """The n-grams of 2 to max_n words that no mark lies in and the bitmaps have, and how often each stands there."""
    names, counts = [], []
    for n, at in _places(words, bits, pair_bits, max_n):
        if n > 2:
            at = at[holds(longer_bits, words.gram_hashes(at, n))]
        now = words.ids[at]
        codes: list[np.ndarray] = []
        for k in range(1, n):  # numbers of the pairs of what came so far and the next word
            codes, now = np.unique(now * len(words.names) + words.ids[at + k], return_inverse=True)
        first = np.zeros(len(codes), np.int64)
        first[now[::-1]] = at[::-1]  # a place for each
        names += [b" ".join([words.names[i] for i in row]) for row in words.ids[first[:, None] + np.arange(n)].tolist()]
        counts.append(np.bincount(now, minlength=len(codes)))
    return names, np.concatenate([np.zeros(0, np.int64), *counts])


def exploded(df: DataFrame, step: Callable[..., tuple], *bits: np.ndarray, numbers: bool = False, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """What `step` finds in each chunk of text: rows (lang, phrase, f), or (hash, f) of a step that gives `numbers`. Equal ones
    of a chunk are one row."""
    held = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            places: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(0).to_pylist()):
                places.setdefault(lang, []).append(i)
            texts = batch.column(1).cast(pa.binary())
            for lang, rows in places.items():
                for tokens in _chunks(texts[i].as_py() for i in rows):
                    if not tokens:
                        continue
                    found, f = step(Words(tokens, lang), *held.value)
                    f = pa.array(f.astype(np.int64))
                    if numbers:
                        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32, casting="unsafe")), f], ["hash", "f"])
                    else:
                        phrases = pa.array(found, pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), phrases, f], ["lang", "phrase", "f"])

    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "hash int, f bigint" if numbers else "lang string, phrase string, f bigint")


def frequent_grams(df: DataFrame, max_n: int, least: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all n-grams with f >= least, and (lang, n) of all words."""
    columns = {"lang_col": lang_col, "text_col": text_col}
    summed = lambda rows, *by: rows.groupBy(*by).agg(F.sum("f").alias("f"))
    words = stable(summed(exploded(df, word_counts, **columns), "lang", "phrase"))
    frequent = F.col("f") >= least
    bits = [bits_of(words.where(frequent).select(F.xxhash64("lang", "phrase").alias("hash")))]
    for step in (pair_buckets, partial(longer_buckets, max_n=max_n)):
        buckets = summed(exploded(df, step, *bits, numbers=True, **columns), "hash").where(frequent) if max_n > len(bits) else None
        bits.append(bits_of(buckets.select(F.col("hash").cast("bigint").alias("hash"))) if buckets is not None else np.zeros(1, np.uint8))
    longer = stable(summed(exploded(df, partial(gram_counts, max_n=max_n), *bits, **columns), "lang", "phrase").where(frequent))
    return words.where(frequent).unionByName(longer), words.groupBy("lang").agg(F.sum("f").alias("n"))


def exact_score() -> Column:
    """floor(2000000 a / (l + r)) in Decimal, whose whole division rounds nothing."""
    return F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")


def collocations(df: DataFrame, max_n: int = 4, least: int = 30, absorbed: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The `top` phrases of 2 to `max_n` words of each language: lang, rank, phrase, words, cut, a, l, r, n, score.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends; words are what spaces and tabs part. `a` counts the
    phrase within pieces, overlaps included, `n` all words of the language. Of the cuts into two parts of `l` and `r`
    occurrences the one of least floor(2000000 a / (l + r)) counts, of equal ones the first. Candidates have `least`
    occurrences; those that stand inside a longer candidate with `absorbed` percent of theirs or more are left out: one
    word longer is enough to ask, as what stands between has as many occurrences as the longer one at least. Order: score
    and a descending, phrase ascending in bytes.

    A null text is empty, a null language "und". Repeated rows all count. Without candidates, and on an empty table, there
    is no row; other columns are ignored. A text of any length is read whole, in chunks that end where pieces do.
    """
    grams, totals = frequent_grams(df, max_n, least, lang_col, text_col)
    parts = F.split("phrase", " ")
    grams = grams.withColumn("words", F.size(parts))
    candidates = grams.where("words > 1")
    place = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", place)
    cuts = cuts.select("*", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice(parts, F.col("cut") + 1, F.col("words")), " ").alias("rest"))
    counts = lambda part, f: grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"])
    scored = cuts.withColumn("score", exact_score()).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "words")).alias("least")).select("lang", "phrase", "least.*")
    tails = F.array(F.array_join(F.slice(parts, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("words") - 1), " "))
    inner = candidates.where("words > 2").select("lang", F.col("f").alias("longer"), F.explode(tails).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = scored.alias("s").join(inner.alias("i"), (F.col("s.lang") == F.col("i.lang")) & (F.col("s.phrase") == F.col("i.phrase")) & (wide("i.longer") * 100 >= wide("s.a") * absorbed), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = left.withColumn("rank", rank("lang", "part")).where(F.col("rank") <= top)  # top rows of each part at most remain
    best = best.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("words").cast("bigint").alias("words"), F.col("cut").cast("bigint").alias("cut"), "a", "l", "r", "n", "score")
