"""Connected components of a link table, by alternating star contraction; nothing but links ever leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stable

#: A key with more rows than this is dealt to several tasks of a join, and the most keys that this can be done for.
HUB_ROWS = 1024
MAX_HUBS = 1 << 17


def joined_evenly(rows: DataFrame, facts: DataFrame, key: str, total: int, counts: DataFrame | None = None) -> DataFrame:
    """`rows` joined with `facts`, which has one row for each `key`, with `n`, the number of rows of that key.

    A hub, a key of many rows, is dealt to as many parts as its rows need, and its fact is given to each of them. As the
    rows of all hubs are `total` at most, there are fewer than MAX_HUBS of them: so much is broadcast at any size.
    `counts` has the key and `n` where that is cheaper to read than `facts`.
    """
    most = max(HUB_ROWS, -(-total // MAX_HUBS))
    parts = F.ceil(F.col("n") / most).cast("int")
    hubs = (facts if counts is None else counts).where(F.col("n") > most).select(key, parts.alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), "parts").cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hubs), key, "left").withColumn("part", part).drop("parts")
    given = facts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(given, [key, "part"]).drop("part")


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, root): every linked node but the roots, with the smallest node of its component.

    Each round ties every node to the least of its neighbours, first from its larger and then from its smaller ones
    (Kiveris et al., "Connected Components in MapReduce and Beyond"). A hub's links are joined, never gathered into a
    list, and not in one task. Links of a node to itself and null ends are ignored.
    """
    ends = F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    now = stable(links.where("a <> b").select(*ends).distinct())
    was = _digest(now)
    while was[0]:
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).union(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = joined_evenly(both.where("v > u"), least, "u", 2 * was[0]).select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("n"))
        small = joined_evenly(large, least, "high", was[0]).where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low")).union(least.select("high", F.col("m").alias("low")))
        now = stable(small.distinct())
        if (digest := _digest(now)) == was:
            break
        was = digest
    return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
