"""Sharding by sampled splitters: byte-balanced shards from size-weighted key samples. DataFrame operations only.

Rows are ordered by (digest of the text, id). A size-weighted sample gives quantile splitters, which cut that order into
many ranges; ranges that still hold too many bytes are cut again from a denser sample of their own. Every range is then
summed by itself, in parallel, and the exact running sum of bytes places each row in a shard. A splitter is a pair of
digest and id, so a group of equal texts, however large, is spread over as many ranges as its bytes need.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stable, uniform

#: Ranges for each shard, sampled rows for each range, and the most bytes of text that a range should stand for.
RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 32
RANGE_BYTES = 4 << 30
#: A range is overfull beyond this multiple of the mean; a denser sample cuts it, at most so many times over.
OVERFULL = 2.0
REFINEMENTS = 3

_PAIR = "array<struct<k:bigint,d:bigint>>"


def _pairs(items: list[tuple[int, int]], kind: str = _PAIR) -> Column:
    return F.from_json(F.lit(json.dumps([{"k": k, "d": d} for k, d in items])), kind)


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below the row's pair, found in two steps of about sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    pair = F.struct(F.col("_key").alias("k"), F.col("_tie").alias("d"))
    width = max(1, math.isqrt(len(splitters)))
    blocks = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    text = json.dumps([[{"k": k, "d": d} for k, d in b] for b in blocks])
    heads, table = _pairs([b[0] for b in blocks]), F.from_json(F.lit(text), f"array<{_PAIR}>")
    block = F.size(F.filter(heads, lambda s: s <= pair))
    inside = F.size(F.filter(F.get(table, F.greatest(block - 1, F.lit(0))), lambda s: s <= pair))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * F.lit(width) + inside).cast("int")


def _quantiles(sample: DataFrame, target: float, within: list[str]) -> list[tuple[int, int]]:
    """Keys at which the running weight of a bounded sample passes another multiple of `target`, within each range."""
    order = Window.partitionBy(*within).orderBy("_key", "_tie")
    step = F.floor(F.sum("_weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(target))
    cut = sample.select("_key", "_tie", step.alias("_step"), *within)
    cut = cut.withColumn("_last", F.lag("_step", 1, 0).over(order)).where("_step > _last")
    return [(r["_key"], r["_tie"]) for r in cut.select("_key", "_tie").distinct().collect()]


def _sampled(rows: DataFrame, total: int, wanted: float, seed: int) -> DataFrame:
    """Each row enters with a chance in proportion to its size; its weight is the bytes it then stands for."""
    chance = F.col("size") * F.lit(wanted / total)
    return rows.where(uniform("_key", "_tie", seed=seed) < chance).withColumn("_weight", F.greatest(F.col("size").cast("double"), F.lit(total / wanted)))


def shard_records(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Place every row of `df` in one of `shards` shards of nearly equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns named in `carry`. The size of a row
    is the UTF-8 bytes of its text plus 1; a null text counts as empty, a null id sorts first. No two shards differ by
    more than about the largest row. `slot` counts the rows of a shard from 0, in the order of (digest, id). Repeated
    rows are all placed. An empty table gives an empty result. Other columns of `df`, whatever their names, are ignored
    unless carried; a carried column may not bear the name of a result column.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint").alias("_key"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("_tie"),
        *carry,
    )
    digest = stable(base.drop(*carry))
    total, rows = digest.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)

    ranges = max(shards * RANGES_PER_SHARD, math.ceil(total / RANGE_BYTES))
    splitters = sorted(_quantiles(_sampled(digest, total, ranges * SAMPLES_PER_RANGE, 7), total / ranges, []))
    for again in range(REFINEMENTS + 1):
        found = digest.groupBy(_range_of(splitters).alias("_range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        full = [r["_range"] for r in found if r["n"] > 1 and r["bytes"] > OVERFULL * total / ranges]
        if not full or again == REFINEMENTS:
            break
        inside = digest.withColumn("_range", _range_of(splitters)).where(F.col("_range").isin(full))
        more = _quantiles(_sampled(inside, total, ranges * SAMPLES_PER_RANGE * 8 ** (again + 1), 8 + again), total / ranges, ["_range"])
        if set(more) <= set(splitters):
            break
        splitters = sorted({*splitters, *more})

    held = {r["_range"]: (r["bytes"], r["n"]) for r in found}
    size_before, rows_before, bytes_at, rows_at = [], [], 0, 0
    for i in range(len(splitters) + 1):
        size_before.append(bytes_at)
        rows_before.append(rows_at)
        bytes_at, rows_at = bytes_at + held.get(i, (0, 0))[0], rows_at + held.get(i, (0, 0))[1]

    def ranked(frame: DataFrame) -> DataFrame:
        """With the row's rank in the whole order, and its shard by the middle of its bytes in that order."""
        order = Window.partitionBy("_range").orderBy("_key", "_tie", "size")
        at = F.col("_range")
        start = F.get(_longs(size_before), at) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        rank = F.get(_longs(rows_before), at) + F.row_number().over(order) - 1
        middle = (start * 2 + F.col("size")).cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(38,0)")
        return frame.withColumns({"_rank": rank, "shard": F.least(F.floor(middle).cast("int"), F.lit(shards - 1))})

    # the first row of a shard lies in the range that holds the shard's first byte, or right behind it
    edges = {}
    for s in range(1, shards):
        edges[s] = max(i for i, at in enumerate(size_before) if at <= s * total // shards)
    crossing = ranked(digest.withColumn("_range", _range_of(splitters)).where(F.col("_range").isin(sorted(set(edges.values())))))
    firsts = [(r["_range"], r["shard"], r["first"]) for r in crossing.groupBy("_range", "shard").agg(F.min("_rank").alias("first")).collect()]
    first_rank = [0] + [min((f for i, shard, f in firsts if i == edges[s] and shard >= s), default=rows_before[edges[s]] + held.get(edges[s], (0, 0))[1]) for s in range(1, shards)]

    source = base if carry else digest
    placed = ranked(source.withColumn("_range", _range_of(splitters)))
    slot = F.col("_rank") - F.get(_longs(first_rank), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)
