"""Nearest neighbours by a block matrix join.

Equal rows are merged, and the vectors are dealt by hash into the rows and columns of a grid: blocks of candidates of BLOCK_BYTES,
parts of queries of QUERY_BYTES. A task has one cell of it. Candidates are copied to each part, and queries, the smaller side,
to each block, in the precision they came in; sorted behind the candidates they stream past the block, which alone is held.
Nothing passes through the driver, and the bytes moved are candidates x parts + queries x blocks.

A tile of queries is multiplied with the block's tiles in int8 values; with the quantisation errors' norms this bounds every
distance from below and above. Only pairs whose lower bound doesn't exceed the query's k-th smallest upper bound are recomputed,
in double precision, and a heap keeps the k nearest of each query; the heaps of all cells are merged by query. As the vectors
themselves are at hand in the cell, a task hands on k rows for a query at most, however many candidates lie closer to each
other than their quantisation errors tell.

Two passes keep small what is merged: the first takes about the square root of the number of blocks, and the k-th nearest found
there is each query's reach in the second, which hands on only what lies within it. The bounds are exact, so nothing is lost.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from rasterloom.llm.common import Scratch, per, tidy

#: Bytes of a block of candidates as a task holds them, and of a part of the queries as they are copied.
BLOCK_BYTES, QUERY_BYTES = 256 << 20, 512 << 20
#: A table of smaller blocks has some of so many rows, up to LEAST_BLOCKS, that cores have work.
BLOCK_ROWS, LEAST_BLOCKS = 500, 64
#: Rows of a candidate and of a query tile; pairs whose distances are recomputed at a time.
TILE_ROWS, TILE_QUERIES, PAIRS = 2048, 1024, 1 << 16


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def grid(rows: int, held: int, asked: int) -> tuple[int, int]:
    """Blocks of the candidates and parts of the queries, from the candidates' number and the bytes of both."""
    return max(per(held, BLOCK_BYTES), min(LEAST_BLOCKS, per(rows, BLOCK_ROWS))), per(asked, QUERY_BYTES)


class Tile:
    """Vectors as they came, as int8 with a scale for each row, and the norms of what that loses."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        full = vectors.astype(np.float64)
        self.scale = np.abs(full).max(axis=1) / 127
        self.scale[self.scale == 0] = 1.0
        self.small = np.rint(full / self.scale[:, None]).clip(-127, 127).astype(np.int8)
        rough = self.small * self.scale[:, None]
        self.norm2 = np.einsum("ij,ij->i", rough, rough)
        self.error = np.sqrt(((full - rough) ** 2).sum(axis=1)) * (1 + 1e-9)

    def bounds(self, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distances from self's rows to other's. The product of int8 tiles is exact in
        float32 up to 1040 dimensions, beyond that it is taken in double precision."""
        kind = np.float32 if self.small.shape[1] <= 1040 else np.float64
        dots = (self.small.astype(kind) @ other.small.astype(kind).T).astype(np.float64)
        d2 = self.norm2[:, None] + other.norm2[None, :] - 2 * dots * self.scale[:, None] * other.scale[None, :]
        slack = 1e-9 * (self.norm2[:, None] + other.norm2[None, :])
        miss = self.error[:, None] + other.error[None, :]
        low = np.sqrt(np.maximum(d2 - slack, 0)) - miss
        high = np.sqrt(np.maximum(d2 + slack, 0)) + miss
        low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf  # squares out of range bound nothing
        return low, high


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, summed component by component in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += np.subtract(a[:, j], b[:, j], dtype=np.float64) ** 2
    return np.sqrt(total)


class Nearest:
    """The k nearest candidates, not beyond their reach, of some queries in one block."""

    def __init__(self, queries: Tile, reach: np.ndarray, k: int):
        self.queries, self.k, self.most = queries, k, reach
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.reach = reach.copy()  # the distance of the k-th nearest so far

    def see(self, tile: Tile, copies: np.ndarray) -> None:
        own = self.queries.ids[:, None] == tile.ids[None, :]
        low, high = self.queries.bounds(tile)
        high[own] = np.inf
        limit = self.reach
        if high.shape[1] >= self.k:
            limit = np.minimum(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero((low <= limit[:, None]) & ~own)
        cuts = range(0, len(q), PAIRS)
        d = np.concatenate([np.zeros(0), *(exact(self.queries.vectors[q[i : i + PAIRS]], tile.vectors[c[i : i + PAIRS]]) for i in cuts)])
        near = np.flatnonzero(d <= self.most[q])
        near = near[np.lexsort((tile.ids[c[near]], d[near], q[near]))]
        begins = np.searchsorted(q[near], q[near])  # q is sorted: only the k nearest of each query's are of use
        near = near[np.arange(len(near)) - begins < self.k]
        q, c, d = q[near], c[near], d[near]
        for i, dist, other, n in zip(q.tolist(), d.tolist(), tile.ids[c].tolist(), copies[c].tolist(), strict=True):
            heap, item = self.heaps[i], (-dist, -other)
            for _ in range(min(n, self.k)):
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
                else:
                    break
        for i in np.unique(q):
            if len(self.heaps[i]) == self.k:
                self.reach[i] = min(self.reach[i], -self.heaps[i][0][0])


class Block:
    """The candidates of one cell, as tiles by the vectors' width."""

    def __init__(self):
        self.tiles: dict[int, list[tuple[Tile, np.ndarray]]] = {}

    def add(self, ids: np.ndarray, widths: np.ndarray, copies: np.ndarray, flat: np.ndarray) -> None:
        for w in np.unique(widths):
            own = np.flatnonzero(widths == w)
            for i in range(0, len(own), TILE_ROWS):
                some = own[i : i + TILE_ROWS]
                self.tiles.setdefault(int(w), []).append((Tile(ids[some], of_rows(flat, widths, some)), copies[some]))


def of_rows(flat: np.ndarray, widths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The vectors of the chosen rows, all of one width, from a flat array of vectors."""
    begins = np.cumsum(np.r_[0, widths])[:-1][chosen]
    return flat[begins[:, None] + np.arange(widths[chosen[0]])]


def block_join(candidates: DataFrame, queries: DataFrame, first: int, last: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in each of the cells first to last - 1. Both sides have id, v and their
    cells; candidates copies, queries asks and reach."""
    cell = F.explode(F.filter("cells", lambda x: x.between(first, last - 1))).alias("cell")
    own = candidates.select(cell, F.lit(False).alias("asking"), "id", "v", "copies", F.lit(0.0).alias("reach"))
    copied = queries.select(cell, F.lit(True).alias("asking"), "id", "v", F.col("asks").alias("copies"), "reach")
    both = own.unionByName(copied).repartitionById(last - first, F.col("cell") - first).sortWithinPartitions("cell", "asking")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block()
        for batch in batches:
            of, asking, ids, copies, reach = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "asking", "id", "copies", "reach"))
            vectors = batch.column("v")
            widths, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
            ends = np.cumsum(np.r_[0, widths])
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (asking[1:] != asking[:-1])) + 1).tolist(), len(of)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if of[i] != at:
                    at, block = of[i], Block()
                part = flat[ends[i] : ends[j]]
                if not asking[i]:
                    block.add(ids[i:j], widths[i:j], copies[i:j], part)
                    continue
                for w in np.unique(widths[i:j]):
                    rows = np.flatnonzero(widths[i:j] == w)
                    for t in range(0, len(rows), TILE_QUERIES):
                        some = rows[t : t + TILE_QUERIES]
                        yield answered(Tile(ids[i:j][some], of_rows(part, widths[i:j], some)), reach[i:j][some], copies[i:j][some], block.tiles.get(int(w), []), k)

    return both.mapInArrow(tidy(run), "query_id long, vec_id long, score double")


def answered(queries: Tile, reach: np.ndarray, asks: np.ndarray, tiles: list[tuple[Tile, np.ndarray]], k: int) -> pa.RecordBatch:
    nearest = Nearest(queries, reach, k)
    for tile, copies in tiles:
        nearest.see(tile, copies)
    q, v, s = [], [], []
    for i, n, heap in zip(queries.ids.tolist(), asks.tolist(), nearest.heaps, strict=True):
        for d, c in heap * min(n, k):  # of equal query rows, each finds the same
            q.append(i), v.append(-c), s.append(-d)
    return pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, is_query: Column | None = None, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in double precision) of each query's k nearest rows.

    Queries are the rows where is_query holds (by default those whose id is divisible by 100); candidates are all rows but
    those with the query's own id. Ties go to the smaller id. Rows with a null id, or a vector that is null, empty, zero or
    holds null or non-finite components, take no part. Vectors of different lengths are never neighbours; very long ones only
    make blocks of fewer rows. Every one of repeated rows is a candidate, and every one of rows with the same query id asks:
    the k nearest of their pairs count. Fewer pairs than k give fewer rows, an empty table none. Other columns aren't read.
    """
    asks = (F.col(key) % 100 == 0 if is_query is None else is_query).alias("asks")
    single = vectors.select(F.col(vector).alias("v")).schema["v"].dataType.elementType == FloatType()
    slim = vectors.select(F.col(key).cast("long").alias("id"), (F.col(vector) if single else F.col(vector).cast("array<double>")).alias("v"), asks)
    good = slim.filter(F.col("id").isNotNull() & usable(F.col("v")))
    scratch = Scratch(vectors.sparkSession)
    merged = scratch.save(good.groupBy("id", "v").agg(F.count("*").alias("copies"), F.count_if("asks").alias("asks")), "vectors")
    width = F.size("v").cast("long") * (4 if single else 8)
    held, asked = F.sum(width + F.size("v") + 64), F.sum(F.when(F.col("asks") > 0, width + 40))
    n = merged.agg(F.struct(F.count("*"), F.coalesce(held, F.lit(0)), F.coalesce(asked, F.lit(0))).alias("bytes")).first().bytes
    blocks, parts = grid(*n)

    def dealt(over: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(over)).cast("int")

    across, down = F.sequence(F.lit(0), F.lit(parts - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    block, part = dealt(blocks, 0), dealt(parts, 1)
    candidates = merged.select("id", "v", "copies", F.transform(across, lambda p: block * parts + p).alias("cells"))
    queries = merged.filter("asks > 0").select("id", "v", "asks", F.transform(down, lambda b: b * parts + part).alias("cells"), F.lit(float("inf")).alias("reach"))
    first = math.isqrt(blocks) * parts
    near = ranked(block_join(candidates, queries, 0, first, k), k).select("query_id", "rank", "vec_id", "score")
    if first == blocks * parts:
        return near
    near = scratch.save(near, "near")
    reach = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("within"))
    narrowed = queries.drop("reach").join(reach, "id", "left").withColumn("reach", F.coalesce("within", F.lit(float("inf"))))
    far = block_join(candidates, narrowed, first, blocks * parts, k)
    return ranked(near.select("query_id", "vec_id", "score").unionByName(far), k).select("query_id", "rank", "vec_id", "score")
