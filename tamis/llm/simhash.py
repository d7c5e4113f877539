"""Near duplicates by SimHash fingerprints, with the pairs found through the anchor points of a covering code.

The 64 bits are cut into three blocks. Two fingerprints at most 4 bits apart differ in at most one bit of some block.
In each block the anchors are the words whose first 15 bits form a Hamming code, the other bits being free: that code
covers the block with radius 1, and every word has exactly one anchor within that radius, its home. If x and y differ in
at most one bit of the block, the home of x lies within 1 + 1 = 2 bits of y. So each fingerprint is replicated to every
anchor within the covering radius plus the block's threshold, and is compared, per anchor, with those that live there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import stable, unused
from .components import connected_components, joined_evenly

THRESHOLD = 4
SHINGLE_WORDS = 4
SEED = 42
CODE_BITS = 15
#: (first bit, bits) of each block; with a threshold of 4 and three blocks, one of them holds at most one difference.
BLOCKS = ((0, 21), (21, 21), (42, 22))
COVERING_RADIUS, BLOCK_THRESHOLD = 1, 1
#: An anchor that is home to more fingerprints than this is split into parts of about this size.
HOT_HOMES = 8192
#: Pairs compared at once, and rows gathered at once, in a task.
PAIRS_AT_ONCE = 1 << 18
#: The most bytes of a table of hot anchors that is broadcast; beyond it, Spark joins it as it sees fit.
BROADCAST_BYTES = 8 << 20


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the text's shingles."""
    import xxhash

    parts = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(parts) - words + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        spans = zip(starts[i : min(i + 8192, n)].tolist(), ends[words - 1 + i : words - 1 + min(i + 8192, n)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Of the first 15 bits: the exclusive or of the positions, from 1, of the bits set; 0 for a word of the code."""
    out = np.zeros(len(words), np.int64)
    for bit in range(CODE_BITS):
        out ^= np.where((words >> bit) & 1, bit + 1, 0)
    return out


def _masks(bits: int, radius: int) -> list[np.ndarray]:
    """For each syndrome, what to flip in a word to get every anchor within `radius` of it."""
    flips = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)]
    flips = np.array(flips, np.int64)
    after = _syndromes(flips)
    return [flips[after == s] for s in range(CODE_BITS + 1)]


#: For each syndrome, the flip that leads to the home: of the bit that the syndrome points to, if any.
_HOME = [np.array([1 << s >> 1], np.int64) for s in range(CODE_BITS + 1)]


def anchors(prints: np.ndarray, radius: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `prints` and anchors: every anchor within `radius` of that fingerprint, block by block; with a
    radius of 0, its homes, which lie within the covering radius."""
    rows, found = [], []
    for block, (first, bits) in enumerate(BLOCKS):
        words = ((prints.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        kinds = _syndromes(words)
        for s, masks in enumerate(_masks(bits, radius) if radius else _HOME):
            at = np.flatnonzero(kinds == s)
            rows.append(np.repeat(at, len(masks)))
            found.append(((words[at, None] ^ masks[None, :]) | (block << 32)).ravel())
    return np.concatenate(rows), np.concatenate(found)


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, found = anchors(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["anchor"])


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1 << 14):
            prints = batch.column(0).slice(i, 1 << 14).to_numpy()
            rows, found = anchors(prints, COVERING_RADIUS + BLOCK_THRESHOLD)
            home_rows, homes = anchors(prints)
            columns = [np.concatenate((homes, found)), np.concatenate((prints[home_rows], prints[rows])), np.repeat([True, False], [len(homes), len(found)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "print", "home"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of `n` nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _forest(keys: np.ndarray, prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to join what the pairs at most THRESHOLD bits apart join; keys are sorted, homes first in each."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((first, [len(keys)])))
    residents = np.add.reduceat(home.astype(np.int64), first)
    group = np.repeat(np.arange(len(first)), sizes)
    guests = np.flatnonzero(~home)
    pairs = residents[group[guests]]
    a_all, b_all = [], []
    ends = np.cumsum(pairs)
    i = 0
    while i < len(guests):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
        n = pairs[i:j]
        b = np.repeat(guests[i:j], n)
        a = np.repeat(first[group[guests[i:j]]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        apart = np.bitwise_count((prints[a] ^ prints[b]).view(np.uint64))
        near = (apart <= THRESHOLD) & (apart > 0)
        a_all.append(a[near])
        b_all.append(b[near])
        if sum(map(len, a_all)) > PAIRS_AT_ONCE:  # keep no more links than nodes
            root = _roots(len(keys), np.concatenate(a_all), np.concatenate(b_all))
            tied = np.flatnonzero(root != np.arange(len(keys)))
            a_all, b_all = [tied], [root[tied]]
        i = j
    if not a_all:
        return prints[:0], prints[:0]
    root = _roots(len(keys), np.concatenate(a_all), np.concatenate(b_all))
    tied = np.flatnonzero(root != np.arange(len(keys)))
    return prints[tied], prints[root[tied]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (anchor, part, home first). Of an anchor too large for one go, the residents (at most about
    HOT_HOMES) are kept while its guests stream by."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()]
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
        keys, prints, home, part = now
        if not len(keys):
            continue
        last = int(np.flatnonzero((keys == keys[-1]) & (part == part[-1]))[0])
        if last == 0:  # one group as yet: its guests so far are compared, and only residents stay
            ids, cut = np.zeros(len(keys), np.int64), slice(0, None)
            kept = [x[home] for x in now]
        else:
            cut = slice(0, last)
            ids = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]) | (part[1:] != part[:-1]))))
            kept = [x[last:] for x in now]
        a, b = _forest(ids[cut], prints[cut], home[cut])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    if kept is not None and len(kept[0]):
        keys, prints, home, _ = kept
        a, b = _forest(np.zeros(len(keys), np.int64), prints, home)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_links(prints: DataFrame, hot_homes: int = HOT_HOMES) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs at most THRESHOLD bits apart do.

    `prints` has one bigint column of distinct fingerprints. Within an anchor the pairs found are reduced to a spanning
    forest at once, so a large group gives as many links as it has members, not the square of it.
    """
    homes = prints.mapInArrow(_homes, "anchor bigint")
    hot = stable(homes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_homes).select("anchor", F.ceil(F.col("n") / hot_homes).cast("int").alias("parts")))
    replicas = prints.mapInArrow(_replicas, "anchor bigint, print bigint, home boolean")
    if n := hot.count():
        replicas = replicas.join(F.broadcast(hot) if n * 24 <= BROADCAST_BYTES else hot, "anchor", "left")
        own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
        all_parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        replicas = replicas.select("anchor", "print", "home", F.explode(all_parts).alias("part"))
    else:
        replicas = replicas.withColumn("part", F.lit(0))
    dealt = replicas.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
    return dealt.mapInArrow(_compared, "a bigint, b bigint")


def _components(docs: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(print, n, first): for each distinct fingerprint of `docs`, its rows and the least of `order` in its whole component;
    and (print, n) alone, which is there already."""
    prints = stable(docs.groupBy("print").agg(F.min(F.struct(*order)).alias("least"), F.count("*").alias("n")))
    stars = connected_components(near_links(prints.select("print")))
    roots = prints.join(stars.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = roots.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    of_print = roots.select("print", "root", F.col("n").alias("copies"))
    named = joined_evenly(of_print, least, "root", prints.count()).select("print", F.col("copies").alias("n"), "first")
    return named, prints.select("print", "n")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, fingerprint (16 hex digits) and component_id.

    Texts are whole; A-Z are lower-cased, words are runs without ASCII white space, shingles have four words (fewer
    words: one shingle of them all). A text that is null or without words has fingerprint zero and links like any other.
    component_id is the smallest id that is reachable over links of at most four differing bits; null ids are passed
    over, and a component of null ids alone has a null one. Repeated rows stay, each with its component. An empty table
    gives an empty result; other columns of `df` are ignored.
    """
    docs = stable(df.select(F.col(id_col).alias("doc_id"), simhash64(F.col(text_col).cast("string")).alias("print")))
    named, counts = _components(docs.select("print", F.col("doc_id").isNull().alias("no_id"), "doc_id"), "no_id", "doc_id")
    out = joined_evenly(docs, named, "print", docs.count(), counts)
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near duplicates, the row with the smallest id, whole; a row without id only if none has one.

    Of rows that share that id the one with the smallest digest of all columns stays, and of rows alike in all columns
    one. Rows are judged by fingerprint, id and digest; whole rows move once, to meet the keys of those that stay.
    """
    columns = df.columns
    digest, no_id = F.xxhash64(*[F.col(c) for c in columns]), F.col(id_col).isNull()
    docs = stable(df.select(simhash64(F.col(text_col).cast("string")).alias("print"), no_id.alias("_no_id"), F.col(id_col).alias("_id"), digest.alias("_digest")))
    named, _ = _components(docs, "_no_id", "_id", "_digest")
    keys = stable(named.select("first.*").distinct())
    own = unused(df, "_digest")
    whole = df.withColumn(own, digest)
    kept = lambda wanted: whole.alias("d").join(wanted.alias("k"), [F.col(f"d.{own}") == F.col("k._digest"), F.col(f"d.{id_col}").eqNullSafe(F.col("k._id"))], "left_semi").select(columns)
    repeated = stable(docs.groupBy("_no_id", "_id", "_digest").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_digest"))
    if repeated.isEmpty():
        return kept(keys)
    again = stable(keys.join(repeated.withColumnRenamed("_id", "_again").withColumnRenamed("_digest", "_also"), (F.col("_digest") == F.col("_also")) & F.col("_id").eqNullSafe(F.col("_again")), "left_semi"))
    once = keys.subtract(again)
    return kept(once).unionByName(kept(again).distinct())
