"""Nearest neighbours by largest inner product: a block matrix join over int8 tiles.

Vectors are packed into blocks: a block is one row with the identifiers and the matrix of its vectors, in the type of
the column. A group of query blocks meets a stripe of candidate blocks in one task, which keeps the queries and goes
through the stripe block by block; so a candidate is shipped once for every GROUP * QUERY_BLOCK queries. In a tile both
sides are rounded to int8 codes with a scale for each vector, and the codes are multiplied as a matrix; with the scales
and the norms of what rounding took, that product gives an upper and a lower bound of every inner product. Pairs whose
upper bound is below the query's k-th best lower bound so far can't be among its nearest; the rest are recomputed in
double precision from the original vectors and merged in a heap for each query, which is carried from tile to tile.
What leaves a task is k rows a query; a window by score merges tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Queries and candidates in a block, query blocks in a group, and candidate blocks that one task goes through for a group.
QUERY_BLOCK, BLOCK, GROUP, TILES = 512, 4096, 16, 8

_BLOCK = "block long, dim int, ids binary, numbers binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors and norms of what rounding took: x = scale * code + rest."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    return code, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return total


def _packed(size: int, kind: str):
    """kind: numpy type of the numbers, float32 or float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, rows = 0, [], []

        def block():
            nonlocal number
            x = np.array(rows, kind)
            out = pa.RecordBatch.from_pylist([{"block": number, "dim": x.shape[1], "ids": np.array(ids, np.int64).tobytes(), "numbers": x.tobytes()}], pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary())]))
            number += 1
            ids.clear(), rows.clear()
            return out

        for batch in batches:
            for ident, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows and len(vector) != len(rows[0]):
                    yield block()
                ids.append(ident)
                rows.append(vector)
                if len(rows) == size:
                    yield block()
        if rows:
            yield block()

    return run


def usable(vectors: DataFrame, column: str = "embedding") -> F.Column:
    """Not null, not empty, every component there and finite, and not zero."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda v: v != 0), F.lit(False))


def one_of_each(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """vectors(ident, column) with one row for each id: of several that with the smallest vector in order of its components."""
    repeated = written(vectors.groupBy(ident).agg(F.count("*").alias("n")).where("n > 1").select(ident), "ann-repeated")
    if repeated.isEmpty():
        return vectors
    several = vectors.join(repeated, ident, "left_semi").groupBy(ident).agg(F.min(column).alias(column))
    return vectors.join(repeated, ident, "left_anti").union(several)


def blocks(vectors: DataFrame, ident: str, column: str, size: int, kind: str, name: str) -> DataFrame:
    """Packed blocks of at most `size` vectors of one length, numbered from 0 through the whole table."""
    packed = vectors.select(ident, column).mapInArrow(_packed(size, kind), _BLOCK)
    kept = written(packed.withColumn("part", F.spark_partition_id()), name)
    # a running count over one row a partition gives the numbers
    counts = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"))
    return kept.join(F.broadcast(before), "part").select((F.col("block") + F.col("before")).alias("block"), "dim", "ids", "numbers")


class Nearest:
    """For each query of a block, the k best (score, -id) as a heap."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, k: int) -> None:
        self.ids, self.numbers, self.k, self.heaps = ids, numbers, k, [[] for _ in ids]
        self.code, self.scale, self.norm, self.rest = quantise(numbers)

    def tile(self, ids: np.ndarray, numbers: np.ndarray, quantised: tuple[np.ndarray, ...]) -> None:
        code, scale, norm, rest = quantised
        # float32 holds products of int8 sums exactly up to 2^24; wider vectors are multiplied in double
        wide = np.float32 if numbers.shape[1] * 127 * 127 < 1 << 24 else np.float64
        with np.errstate(over="ignore", invalid="ignore"):
            near = (self.code.astype(wide) @ code.astype(wide).T) * self.scale[:, None] * scale[None, :]
            # |q.x - near| <= |q'| |rx| + |rq| |x'| + |rq| |rx|; a little more for rounding here
            slack = (self.norm[:, None] * rest[None, :] + self.rest[:, None] * (norm + rest)[None, :]) * (1 + 1e-9) + 1e-12
            upper, lower = near + slack, near - slack
        # numbers near the end of what double holds: nothing is known of such a pair but by its product
        upper[np.isnan(upper)], lower[np.isnan(lower)] = np.inf, -np.inf
        own = self.ids[:, None] == ids[None, :]
        upper[own], lower[own] = -np.inf, -np.inf
        at_least = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])
        if lower.shape[1] >= self.k:
            at_least = np.maximum(at_least, np.partition(lower, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero((upper >= at_least[:, None]) & ~own)
        for start in range(0, len(q), 1 << 16):
            qs, cs = q[start : start + (1 << 16)], c[start : start + (1 << 16)]
            for i, ident, score in zip(qs.tolist(), ids[cs].tolist(), exact_products(self.numbers[qs], numbers[cs]).tolist(), strict=True):
                self.add(i, score, ident)

    def add(self, i: int, score: float, ident: int) -> None:
        heap = self.heaps[i]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -ident))
        elif (score, -ident) > heap[0]:
            heapq.heapreplace(heap, (score, -ident))

    def rows(self) -> pa.RecordBatch:
        found = [(q, -i, s) for q, h in zip(self.ids.tolist(), self.heaps, strict=True) for s, i in h]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def _tiles(k: int, kind: str):
    """Over rows sorted by (group, stripe, dim, side, block): the query blocks of a group (side 0), then a stripe's candidate blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                group, stripe, side, _, dim, ids, numbers = (batch.column(c)[i].as_py() for c in range(7))
                ids, numbers = np.frombuffer(ids, np.int64), np.frombuffer(numbers, kind).reshape(-1, dim)
                if (group, stripe, dim) != key:
                    yield from (own.rows() for own in asked)
                    key, asked = (group, stripe, dim), []
                if side == 0:
                    asked.append(Nearest(ids, numbers, k))
                elif asked:  # no query of this length otherwise
                    quantised = quantise(numbers)
                    for own in asked:
                        own.tile(ids, numbers, quantised)
        yield from (own.rows() for own in asked)

    return run


def nearest(vectors: DataFrame, queries: F.Column | None = None, k: int = 20, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k candidates of largest inner product, exactly.

    queries: which rows are queries (here: id divisible by 20); all usable rows but the query's own are candidates.
    Ties go to the smaller vec_id. Null, empty or zero vectors, vectors with null or non-finite components and rows
    without an id take no part. Vectors only meet those of their own length. Of rows with the same id one takes part,
    that with the smallest vector in order of its components. Doubles are taken as they are, other numbers as float32
    holds them. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    queries = F.col(ident) % 20 == 0 if queries is None else queries
    kind, stored = ("float64", "array<double>") if vectors.schema[column].dataType.elementType.simpleString() == "double" else ("float32", "array<float>")
    good = vectors.select(F.col(ident).cast("long").alias(ident), F.col(column).cast(stored).alias(column), queries.alias("_asked"))
    asking = F.col("_asked")
    good = good.where(F.col(ident).isNotNull() & usable(vectors, column))
    once = one_of_each(good.select(ident, F.struct(column, "_asked").alias("_own")), ident, "_own").select(ident, f"_own.{column}", "_own._asked")
    mine = blocks(once, ident, column, BLOCK, kind, "ann-vectors").withColumn("stripe", F.floor(F.col("block") / TILES))
    asked = blocks(once.where(asking), ident, column, QUERY_BLOCK, kind, "ann-queries").withColumn("group", F.floor(F.col("block") / GROUP))
    n_groups, n_stripes = -(-asked.count() // GROUP), -(-mine.count() // TILES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)).cast("array<long>"))
    # each query block goes to each stripe once, each candidate block to each group once: the tiles of the product
    columns = ["group", "stripe", "side", "block", "dim", "ids", "numbers"]
    left = asked.select("group", every(n_stripes).alias("stripe"), F.lit(0).alias("side"), "block", "dim", "ids", "numbers")
    right = mine.select(every(n_groups).alias("group"), "stripe", F.lit(1).alias("side"), "block", "dim", "ids", "numbers")
    # a number of its own, so that adaptive execution doesn't put all tiles in one task for being few bytes
    tasks = max(1, min(n_groups * n_stripes, 100_000))
    tiles = left.union(right).select(columns).repartition(tasks, "group", "stripe").sortWithinPartitions("group", "stripe", "dim", "side", "block")
    best = tiles.mapInArrow(_tiles(k, kind), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
