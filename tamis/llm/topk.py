"""Exact top-k inner products by an impact-ordered index, read score at a time.

Vectors are dealt into blocks. In a block each dimension has posting segments, one for each level of its quantised
values. For a query, a segment's impact is the most that its vectors can gain in that dimension over the least that any
vector of the block has there. Segments are read by descending impact, their impacts added to accumulators. What a
vector can still gain is at most the sum, over the dimensions, of the next impact; once a vector's bound is under a score
that at least k other vectors are known to reach, it is no member. Reading stops only when few enough vectors have no
such proof, and those are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stable, uniform

SCALE = 1024
#: Vectors of a block, queries whose answers leave a task together, levels of a dimension, and rounds in which the impacts are
#: read.
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
LEVELS = 32
ROUNDS = 5
#: Reading goes on until this share of the block, or fewer, may be members.
RESCORED_SHARE = 0.04
#: Rows of the sample that gives each query a score that its k-th neighbour reaches at least.
SEED_ROWS = 4096


def quantised(vector: Column) -> Column:
    """floor(1024 x) of each component as a bigint; null if the vector or a component is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of int64; a shorter vector has zeros behind."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class ImpactIndex:
    """The posting segments of one block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, (self.n, self.width) = vectors, vectors.shape
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        step = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        level = (vectors - self.low) // step
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        counts = np.zeros((self.width, LEVELS), np.int64)
        np.add.at(counts, (np.arange(self.width)[None, :], level), 1)
        self.ends = np.concatenate((np.zeros((self.width, 1), np.int64), np.cumsum(counts, axis=1)), axis=1)
        # the least and the greatest value that a segment can hold
        grid = self.low[:, None] + step[:, None] * np.arange(LEVELS)
        self.least, self.most = grid, np.minimum(grid + step[:, None] - 1, self.high[:, None])

    def members(self, query: np.ndarray, reached: int) -> np.ndarray:
        """Every vector whose inner product with `query` may be `reached` or more; the others are proved to be below."""
        gain = np.maximum(query[:, None] * self.least, query[:, None] * self.most)
        floor = np.minimum(query * self.low, query * self.high)
        impact = np.where(np.diff(self.ends) > 0, gain - floor[:, None], 0)
        up = query >= 0
        impact = np.where(up[:, None], impact[:, ::-1], impact)  # now by descending impact in each dimension
        tops = np.maximum.accumulate(impact[:, ::-1], axis=1)[:, ::-1]  # an empty segment has the next one's impact
        need, got = reached - int(floor.sum()), np.zeros(self.n)
        done = np.zeros(self.width, np.int64)
        few = max(16, int(self.n * RESCORED_SHARE))
        largest = float(tops.max(initial=0))
        for turn in range(1, ROUNDS + 1):
            bar = largest * (1 - turn / ROUNDS) ** 2 if turn < ROUNDS else -1.0
            upto = (tops > bar).sum(axis=1) if turn < ROUNDS else np.full(self.width, LEVELS)
            ids, weights = [], []
            for d in np.flatnonzero(upto > done):
                a, b = done[d], upto[d]
                ends = self.ends[d]
                sizes = np.diff(ends)
                if up[d]:
                    part, sizes = self.order[d, ends[LEVELS - b] : ends[LEVELS - a]], sizes[LEVELS - b : LEVELS - a]
                    weights.append(np.repeat(impact[d, a:b][::-1], sizes))
                else:
                    part, sizes = self.order[d, ends[a] : ends[b]], sizes[a:b]
                    weights.append(np.repeat(impact[d, a:b], sizes))
                ids.append(part)
            if ids:
                got += np.bincount(np.concatenate(ids), np.concatenate(weights).astype(np.float64), self.n)
            done = upto
            left = int(np.where(done < LEVELS, tops[np.arange(self.width), np.minimum(done, LEVELS - 1)], 0).sum())
            may = np.flatnonzero(got + left >= need - 1 - 1e-9 * abs(need))  # sums of doubles may be off by less
            if len(may) <= few:
                break
        return may

    def top(self, query: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, reached: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the block's best k that reach `reached`, ties to smaller ids; never rows in `own`."""
        may = self.members(query, reached)
        may = may[~own[may]]
        scores = self.vectors[may] @ query
        keep = scores >= reached
        may, scores = may[keep], scores[keep]
        best = np.lexsort((ids[may], -scores))[:k]
        return may[best], scores[best]


def top_inner_products(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row that `queries` selects: query_id, rank, vec_id and score of the k rows of greatest inner product.

    Components become floor(1024 x); scores are exact integers. All rows but those of the query's own id are candidates;
    ties go to the smaller id. Vectors that are null or hold a null or non-finite component, and rows without an id, take
    no part. Repeated rows count once; of one id with several vectors, each vector is a candidate, and as a query it asks
    once more. Vectors of different lengths are compared as if zeros followed the shorter. Fewer than k candidates: all.
    An empty table gives an empty result; other columns are ignored. Vectors whose inner
    products may not fit a long raise an ArithmeticError before any work.

    Vectors are dealt into blocks. A block's come to its task before the queries do: its index is built once, and queries
    stream past it, QUERY_ROWS at a time.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), quantised(F.col(vector_col)).alias("vector"), queries.alias("asks"))
    rows = stable(rows.where("vec_id is not null and vector is not null"))
    size = F.greatest(F.abs(F.array_max("vector").cast("double")), F.abs(F.array_min("vector").cast("double")))
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(size)).first()
    width, largest = max(1, width or 1), largest or 0.0
    if width * largest**2 >= 2.0**62:
        raise ArithmeticError(f"inner products of {width} components up to {largest:.0f} may not fit a long")
    sample = rows.where(uniform("vec_id", seed=11) < SEED_ROWS / max(1, n)).select("vec_id", "vector").dropDuplicates().orderBy("vec_id").limit(2 * SEED_ROWS)
    held = sample.toArrow()  # bounded: at most 2 * SEED_ROWS vectors
    seeds = df.sparkSession.sparkContext.broadcast((held["vec_id"].to_numpy(), _matrix(held["vector"], width)))

    def reach(batches):
        """What the k-th best of the sample scores: the k-th best of all scores that at least."""
        ids, vectors = seeds.value
        for batch in batches:
            asks = _matrix(batch.column(1), width)
            scores = (vectors.astype(np.float64) @ asks.astype(np.float64).T).T if len(ids) else np.zeros((len(asks), 0))
            own = batch.column(0).to_numpy()[:, None] == ids[None, :]
            scores = np.where(own, -np.inf, scores)
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(asks), -np.inf)
            kth = np.where(np.isfinite(kth), kth - np.abs(kth) * 1e-12 - 1, -float(1 << 62))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.floor(kth).astype(np.int64))], ["vec_id", "vector", "reached"])

    blocks = max(1, -(-n // block_rows))
    asking = rows.where("asks").select("vec_id", "vector").distinct().mapInArrow(reach, "vec_id bigint, vector array<bigint>, reached bigint")
    asking = asking.withColumn("cb", F.explode(_upto(blocks)))
    given = rows.select("vec_id", "vector", F.lit(None).cast("bigint").alias("reached"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).alias("cb"))

    def search(batches):
        block, held, index, ids = None, [], None, np.zeros(0, np.int64)
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), pc.is_valid(batch.column(3)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if a == b:
                    continue
                if numbers[a] != block:
                    block, held, index = numbers[a], [], None
                part = batch.slice(a, b - a)
                own, vectors = part.column(1).to_numpy(), _matrix(part.column(2), width)
                if not asks[a]:
                    held.append(np.concatenate((own[:, None], vectors), axis=1))
                    continue
                if held:
                    once = np.unique(np.concatenate(held), axis=0)
                    held, ids, index = [], once[:, 0].copy(), ImpactIndex(once[:, 1:].copy())
                if index is None:
                    continue
                for s in range(0, len(own), QUERY_ROWS):
                    out: list[list] = [[], [], []]
                    for q, query, reached in zip(own[s : s + QUERY_ROWS], vectors[s : s + QUERY_ROWS], part.column(3).to_numpy()[s : s + QUERY_ROWS], strict=True):
                        at, scores = index.top(query, ids == q, ids, k, int(reached))
                        out[0].append(np.full(len(at), q))
                        out[1].append(ids[at])
                        out[2].append(scores)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])

    both = asking.select("cb", "vec_id", "vector", "reached").unionByName(given.select("cb", "vec_id", "vector", "reached"))
    dealt = both.repartition(blocks, "cb").sortWithinPartitions("cb", F.col("reached").isNotNull())
    found = dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
