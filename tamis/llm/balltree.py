"""Hard negatives by branch and bound over ball trees.

Vectors are dealt into blocks, and a task builds one tree for each block, once. Anchors stream past it. A node is a ball
around its vectors, so an anchor's inner products with them lie between those with the centre minus and plus the radius
times the anchor's length. A node is passed over if all of that lies outside the wanted window of scores, or strictly
beneath the k-th best score the anchor has in this block already, or if none of its labels is wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import unused

SCALE = 256
#: Vectors of a leaf, bytes of the vectors of a block at most, and the rows for which another block is begun while there
#: are cores without one.
LEAF_ROWS = 128
BLOCK_BYTES = 64 << 20
BLOCK_ROWS = 1024
#: Questions that are asked of a tree at a time.
ASKED = 1024
NONE = -(1 << 62)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale x) of each component as a bigint; null if the vector or a component is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


class BallTree:
    """The vectors of a block, in the order of the leaves of a balanced tree: node i has the halves 2 i + 1 and 2 i + 2."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        points = vectors.astype(np.float64)
        order, self.spans = np.arange(len(ids)), [(0, len(ids))]
        self.depth = 0
        while len(ids) > LEAF_ROWS << self.depth:
            level = []
            for a, b in self.spans[(1 << self.depth) - 1 :]:
                own, middle = order[a:b], (b - a) // 2
                if b - a > 1:
                    widest = np.ptp(points[own], axis=0).argmax()
                    order[a:b] = own[np.argpartition(points[own, widest], middle)]
                level += [(a, a + middle), (a + middle, b)]
            self.spans += level
            self.depth += 1
        self.vectors, self.points, self.ids, self.labels = vectors[order], points[order], ids[order], labels[order]
        self.bits = np.uint64(1) << (self.labels.astype(np.uint64) % np.uint64(64))
        n = len(self.spans)
        self.centre, self.radius, self.any = np.zeros((n, points.shape[1])), np.zeros(n), np.zeros(n, np.uint64)
        self.one, self.only = np.zeros(n, bool), np.zeros(n, np.int64)  # nodes of one label, and which
        for i, (a, b) in enumerate(self.spans):
            if a < b:
                self.centre[i] = self.points[a:b].mean(axis=0)
                self.radius[i] = np.sqrt(((self.points[a:b] - self.centre[i]) ** 2).sum(axis=1).max()) * (1 + 1e-9)
                self.any[i] = np.bitwise_or.reduce(self.bits[a:b])
                self.one[i], self.only[i] = (self.labels[a:b] == self.labels[a]).all(), self.labels[a]

    def bounds(self, asks: np.ndarray, length: np.ndarray, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """What each of `asks` scores in each node at least and at most. The slack covers the rounding of both products."""
        at, reach = asks @ self.centre[nodes].T, length[:, None] * self.radius[None, nodes]
        slack = 1 + 1e-9 * length[:, None] * (np.sqrt((self.centre[nodes] ** 2).sum(axis=1)) + self.radius[nodes])[None, :]
        return at - reach - slack, at + reach + slack

    def search(self, asks: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best k in [low, high] for each question, of the same or of another label, never of the id
        `own`; NONE where there are fewer. exact: products of the vectors fit a double without rounding."""
        m = len(asks)
        scores, ids = np.full((m, k), NONE, np.int64), np.full((m, k), np.iinfo(np.int64).max, np.int64)
        points, bit = asks.astype(np.float64), np.uint64(1) << (labels.astype(np.uint64) % np.uint64(64))
        length = np.sqrt((points**2).sum(axis=1))

        def wanted(nodes: slice) -> np.ndarray:
            if same:
                return (self.any[None, nodes] & bit[:, None]) != 0
            return (self.any[None, nodes] != 0) & ~(self.one[None, nodes] & (self.only[None, nodes] == labels[:, None]))

        def open_(nodes: slice) -> tuple[np.ndarray, np.ndarray]:
            least, most = self.bounds(points, length, nodes)
            return wanted(nodes) & (most >= low[:, None]) & (least <= high[:, None]) & (most >= scores[:, -1:]), most

        def leaf(node: int, who: np.ndarray) -> None:
            a, b = self.spans[node]
            if exact:
                got = (points[who] @ self.points[a:b].T).astype(np.int64)
            else:
                got = asks[who] @ self.vectors[a:b].T
            fit = (got >= np.maximum(low[who], scores[who, -1])[:, None]) & (got <= high[who][:, None]) & (self.ids[None, a:b] != own[who][:, None])
            fit &= (self.labels[None, a:b] == labels[who][:, None]) == same
            some = fit.any(axis=1)
            who, fit, got = who[some], fit[some], got[some]
            if len(who):
                both = np.concatenate((scores[who], np.where(fit, got, NONE)), axis=1)
                names = np.concatenate((ids[who], np.where(fit, np.broadcast_to(self.ids[a:b], fit.shape), np.iinfo(np.int64).max)), axis=1)
                best = np.lexsort((names, -both), axis=-1)[:, :k]
                scores[who], ids[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)

        first, count = (1 << self.depth) - 1, 1 << self.depth
        alive = open_(slice(0, 1))[0]
        for level in range(1, self.depth + 1):  # a half is open only if the whole is
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            alive = np.repeat(alive, 2, axis=1) & open_(nodes)[0]
        leaves = slice(first, first + count)
        most = np.where(alive, open_(leaves)[1], -np.inf)
        nearest = most.argmax(axis=1)
        rest = alive.copy()
        rest[np.arange(m), nearest] = False
        for j in np.unique(nearest[alive.any(axis=1)]):  # each first asks its most promising leaf, which makes the k-th score
            leaf(first + j, np.flatnonzero((nearest == j) & alive[np.arange(m), nearest]))
        for j in np.argsort(-most.max(axis=0, initial=-np.inf, where=rest)):
            who = np.flatnonzero(rest[:, j] & (most[:, j] >= scores[:, -1]))
            if len(who):
                leaf(first + j, who)
        return scores, ids


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of int64; a shorter vector has zeros behind."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _once(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, ids and labels of what a block was given, equal rows once."""
    ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
    if len(np.unique(ids)) < len(ids):
        rows = np.unique(np.concatenate((ids[:, None], labels[:, None], vectors), axis=1), axis=0)
        ids, labels, vectors = rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2:].copy()
    return vectors, ids, labels


_ROW = ["block", "asks", "id", "label", "vector", "low", "high", "key", "carried"]


def _past_trees(rows: DataFrame, asking: DataFrame, blocks: int, width: int, same: bool, k: int, exact: bool) -> DataFrame:
    """(id, key, carried, other, score) of the best k in each block for every question, asked as (id, label, vector, low,
    high, key, carried). Vectors that are alike in id and label count once.

    A block's vectors come to its task before the questions do; so the tree is built once, and questions are never held
    together."""
    given = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "label", *[F.lit(None).cast("bigint").alias(c) for c in ("low", "high", "key", "carried")], "vector")
    asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "label", "low", "high", "key", "carried", "vector")
    both = given.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks").select(*_ROW)

    def run(batches):
        block, held, tree = None, [], None
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if numbers[a] != block:
                    block, held, tree = numbers[a], [], None
                ids, labels, vectors = part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), width)
                if not asks[a]:
                    held.append((ids, labels, vectors))
                    continue
                if tree is None and held:
                    tree = BallTree(*_once(held))
                    held = []
                low, high, keys, carried = (part.column(i).to_numpy() for i in (5, 6, 7, 8))
                for s in range(0, len(ids) if tree is not None else 0, ASKED):
                    at = slice(s, s + ASKED)
                    scores, found = tree.search(vectors[at], ids[at], labels[at], low[at], high[at], same, k, exact)
                    who, place = np.nonzero(scores > NONE)
                    columns = ids[at][who], keys[at][who], carried[at][who], found[who, place], scores[who, place]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "key", "carried", "other", "score"])

    return both.mapInArrow(run, "id bigint, key bigint, carried bigint, other bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each question, with their rank; the blocks' best are few for each."""
    order = Window.partitionBy("id", "key").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, blocks: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that `anchors` selects and each
    of its first `positives` other rows of its label, the first `k` rows of other labels whose score lies from `low` to
    `high` percent of the positive's. `label` says what counts as the label; by default it is the column.

    Components become floor(scale x); scores are exact integers, greater ones come first, ties by the smaller id. Rows
    with a null id or label, a null vector, or a null or non-finite component take no part. Rows that are alike in id,
    label and vector count once; of an id with several vectors each is a candidate, and one anchor (the least vector)
    asks. Shorter vectors are compared as if zeros followed. Fewer rows than asked for: all; a positive with no row in its
    window has no result, and nor has an anchor without positives. An empty table gives an empty result; other columns are
    ignored. Vectors whose inner products may not fit a long raise an ArithmeticError before any work.
    """
    asks = unused(df, "_asks")
    label = F.col(label_col) if label is None else label
    rows = df.withColumn(asks, anchors).select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), scaled(F.col(vector_col), scale).alias("vector"), F.col(asks).alias("asks"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    size = F.greatest(F.abs(F.array_max("vector").cast("double")), F.abs(F.array_min("vector").cast("double")))
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(size)).first()
    width, largest = max(1, width or 1), largest or 0.0
    if width * largest**2 >= 2.0**62:
        raise ArithmeticError(f"inner products of {width} components up to {largest:.0f} may not fit a long")
    exact = width * largest**2 < 2.0**53
    if blocks is None:
        blocks = max(1, -(-n * width * 8 // BLOCK_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, n // BLOCK_ROWS))
    asking = rows.where("asks").groupBy("id").agg(F.min(F.struct("vector", "label")).alias("x")).select("id", "x.label", "x.vector")
    nothing = F.lit(0).cast("bigint")
    first = asking.select("*", F.lit(NONE + 1).alias("low"), F.lit(1 << 62).alias("high"), nothing.alias("key"), nothing.alias("carried"))
    near = _best(_past_trees(rows, first, blocks, width, True, positives, exact), positives).select("id", F.col("other").alias("key"), F.col("score").alias("carried"))
    # one question for each positive; its window in whole numbers, rounded inwards
    wide = F.col("carried").cast("decimal(20,0)")
    windows = near.join(asking, "id").withColumns({"low": F.ceil(wide * low / 100).cast("bigint"), "high": F.floor(wide * high / 100).cast("bigint")})
    found = _best(_past_trees(rows, windows.where("low <= high"), blocks, width, False, k, exact), k)
    return found.select(F.col("id").alias("anchor_id"), F.col("key").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("carried").alias("positive_score"), F.col("score").alias("negative_score"))
