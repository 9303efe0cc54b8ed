"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors become integers (``floor(scale x component)``) and are packed, without a
shuffle, into blocks in vertical layout: one contiguous array per dimension.  A task
gets a tile, some query blocks and some candidate blocks.  For each query it adds up
the inner products dimension block by dimension block; what the remaining dimensions
can still add is bounded by the product of the remaining norms (Cauchy-Schwarz), and
candidates whose bound is below the query's current k-th best score are compacted
away.  Ties with the k-th score survive, so the result is exact with ties by smaller
id.  Tiles are merged per query, k rows from each.

Block sizes bound the memory of a task; the number of tiles follows the input.

Defined results: vectors that are null, or hold a null or non-finite component, and
rows without an id take no part; rows that repeat an id are each a candidate for other ids
and each a query, whose results are ranked together; shorter vectors are filled up with zeros; a query with fewer than k candidates gets
all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialize

SCALE = 64
STEP = 8
BLOCK_ROWS = 2048
TILE_CANDIDATES, TILE_QUERIES = 64 * BLOCK_ROWS, 512
LEAST_GROUPS = 4

BLOCK_DDL = "block long, n int, dims int, ids binary, data binary"


def valid(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v array<long>): the rows that take part, as integers; rows that repeat an id each take part."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(finite_value(c), F.lit(False))))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def finite_value(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK_ROWS vectors in vertical layout."""
    number = TaskContext.get().partitionId() << 32

    def block(ids: np.ndarray, rows: list) -> pa.RecordBatch:
        dims = max(map(len, rows))
        data = np.zeros((dims, len(rows)), np.int64)
        for k, row in enumerate(rows):
            data[: len(row), k] = row
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([dims], pa.int32()),
            pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
            names=["block", "n", "dims", "ids", "data"])

    ids, rows = [], []
    for batch in batches:
        values = batch["v"].flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(batch["v"].value_lengths().to_numpy(zero_copy_only=False))
        ids += batch["id"].to_pylist()
        rows += np.split(values, ends[:-1])
        while len(rows) >= BLOCK_ROWS:
            yield block(np.array(ids[:BLOCK_ROWS], np.int64), rows[:BLOCK_ROWS])
            ids, rows, number = ids[BLOCK_ROWS:], rows[BLOCK_ROWS:], number + 1
    if rows:
        yield block(np.array(ids, np.int64), rows)


class Block:
    """A candidate block with the norms of what is left after each dimension step."""

    def __init__(self, row: dict, dims: int):
        data = np.frombuffer(row["data"], np.int64).reshape(row["dims"], row["n"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.data = np.zeros((dims, row["n"]), data.dtype)
        self.data[: row["dims"]] = data
        self.exact = float(np.abs(data).max(initial=0)) ** 2 * max(dims, 1) < 2**52
        self.values = self.data.astype(np.float64) if self.exact else self.data
        self.rest = remaining(self.values.astype(np.float64))


def remaining(values: np.ndarray) -> np.ndarray:
    """Row s: norm of the dimensions from step s on, per vector; a last row of zeros."""
    squares = np.add.reduceat(values**2, np.arange(0, len(values), STEP), axis=0) if len(values) else np.zeros((0, values.shape[1]))
    return np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, values.shape[1]))]))


def best_of(query: np.ndarray, own_id: int, rest: np.ndarray, block: Block, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the block's candidates that may be among the k best, given a score to reach."""
    alive = np.flatnonzero(block.ids != own_id)
    partial = np.zeros(len(alive), block.values.dtype)
    steps = len(rest) - 1
    for s in range(steps):
        at = slice(s * STEP, (s + 1) * STEP)
        side = block.values[at] if len(alive) == block.values.shape[1] else block.values[at][:, alive]
        partial = partial + query[at] @ side
        left = rest[s + 1] * block.rest[s + 1][alive]
        if len(alive) > k:
            # the k-th best of the lower bounds is a score that k candidates are sure to reach
            low = partial - left
            floor = max(floor, float(np.partition(low, len(low) - k)[len(low) - k]))
        keep = partial + left >= floor - 1e-6 * (1.0 + abs(floor) if np.isfinite(floor) else 1.0)
        if not keep.all():
            alive, partial = alive[keep], partial[keep]
    return block.ids[alive], partial


def search_tile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The tile's k best per query; rows come sorted by tile, queries first."""
    tile, queries, candidates = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if not queries or not candidates:
            return
        dims = max(r["dims"] for r in [*queries, *candidates])
        blocks = [Block(r, dims) for r in candidates]
        for row in queries:
            own = Block(row, dims)
            for c, own_id in enumerate(own.ids):
                ids, scores, floor = np.zeros(0, np.int64), np.zeros(0), -np.inf
                for block in blocks:
                    query = own.values[:, c] if block.exact else own.data[:, c]
                    new_ids, new_scores = best_of(query, own_id, own.rest[:, c], block, k, floor)
                    ids, scores = np.concatenate([ids, new_ids]), np.concatenate([scores, new_scores.astype(np.float64) if block.exact and own.exact else new_scores])
                    order = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[order], scores[order]
                    if len(ids) == k:
                        floor = float(scores[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), own_id)), pa.array(ids), pa.array(scores.astype(np.int64))],
                    names=["query_id", "vec_id", "score"])

    for batch in batches:
        for row in batch.to_pylist():
            if (row["qg"], row["cg"]) != tile:
                yield from flush()
                tile, queries, candidates = (row["qg"], row["cg"]), [], []
            (queries if row["kind"] == 0 else candidates).append(row)
    yield from flush()


def search(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
           scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by ``every``."""
    rows = materialize(valid(vectors, key, vector, scale), "topk-vectors")
    n = rows.count()
    c_groups = max(LEAST_GROUPS, -(-n // TILE_CANDIDATES))
    q_groups = max(1, -(-n // (every * TILE_QUERIES)))
    candidates = rows.mapInArrow(pack, BLOCK_DDL)
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0).mapInArrow(pack, BLOCK_DDL)

    def groups(m: int):
        return F.sequence(F.lit(0), F.lit(m - 1))

    def group(m: int):
        return F.pmod(F.xxhash64("block"), F.lit(m)).cast("int")

    tiles = queries.select("*", F.lit(0).alias("kind"), group(q_groups).alias("qg"), F.explode(groups(c_groups)).alias("cg")).unionByName(
        candidates.select("*", F.lit(1).alias("kind"), group(c_groups).alias("cg"), F.explode(groups(q_groups)).alias("qg")))
    best = tiles.repartition("qg", "cg").sortWithinPartitions("qg", "cg", "kind").mapInArrow(
        lambda batches: search_tile(batches, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
