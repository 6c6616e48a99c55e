"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop, join_groups, written


#: Edges that are contracted together before a step.
CHUNK = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of a task's edges as stars: every node of a piece hangs on the piece's smallest. Nothing is shuffled for it."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        above: dict[int, int] = {}

        def top(i: int) -> int:
            while (j := above.get(i, i)) != i:
                above[i] = i = above.get(j, j)
            return i

        for u, v in zip(table["u"].to_pylist(), table["v"].to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        pairs = [(i, t) for i in nodes if (t := top(i)) != i]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            if held and sum(b.num_rows for b in held) + part.num_rows > CHUNK:
                yield stars()
                held.clear()
            held.append(part)
    if held:
        yield stars()


def _step(edges: DataFrame, n: int) -> DataFrame:
    """A large and a small star over n edges (u, v) with u > v: hang neighbours on the smallest node of a neighbourhood.

    A node with a large share of all edges isn't one task's: its smallest neighbour is broadcast."""
    edges = edges.mapInArrow(_contracted, "u long, v long")
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = lambda rows, least: join_groups(rows, least, ["u"], "degree", 2 * n, F.xxhash64("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    large = hung(both, least).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    small = hung(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return small.where("u > v").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges in the shared folder, with their number and checksum, which the writing job observes on its way."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node but the smallest ones themselves.

    edges: two long columns a, b in any order; loops, repeated edges and nulls don't matter. A step is written to the
    shared folder, so lineage stays short and a lost executor costs a step at most.
    """
    own = edges.toDF("a", "b").where("a is not null and b is not null and a <> b")
    now, before = _written(own.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(rounds):
        if not before[0]:
            break
        step, after = _written(_step(now, before[0]))
        drop(now)
        now = step
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
