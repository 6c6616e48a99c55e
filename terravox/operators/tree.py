"""Hierarchies (node_id, parent_id, ...): closure, roll-ups, transforms, removal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import step

IDENTITY = (1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0)


def closure(nodes: DataFrame, most: int = 64) -> DataFrame:
    """(ancestor, node_id, depth) with every node as its own ancestor; by doubling, so depth d takes log d joins."""
    links = nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth"))
    self_ = nodes.select("node_id", F.col("node_id").alias("ancestor"), F.lit(0).alias("depth"))
    reach, frontier = links, links
    for _ in range(most):
        up = reach.select(F.col("node_id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        longest = frontier.join(up, "ancestor").select("node_id", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        new = step(longest.distinct().join(reach.select("node_id", "ancestor"), ["node_id", "ancestor"], "left_anti"))
        if new.isEmpty():
            return self_.unionByName(reach)
        reach, frontier = step(reach.unionByName(new)), new
    raise RuntimeError("the hierarchy has a cycle")


def levels(nodes: DataFrame, most: int = 64) -> list[DataFrame]:
    """The nodes by depth, roots first; a level is read by the next through one join on the parent."""
    out, above = [], nodes.where("parent_id is null")
    for _ in range(most):
        if above.isEmpty():
            return out
        out.append(above)
        above = step(nodes.join(above.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi"))
    raise RuntimeError("the hierarchy has a cycle or is too deep")


def roll_up(nodes: DataFrame, own: dict[str, F.Column], merge: dict[str, Callable[[str], F.Column]], lifted: dict[str, F.Column] | None = None) -> DataFrame:
    """(node_id, ...): aggregates over each node's subtree, itself included.

    own: a node's own values; merge: how values of one name are put together (F.sum, F.min, ...); lifted: what a value
    becomes on its way to the parent (a height plus 1, say). Level by level from the deepest: what a level hands on is
    aggregated by parent before it meets the level above, so no pair of ancestor and descendant is formed."""
    below, done = None, None
    for level in reversed(levels(nodes)):
        mine = level.select("node_id", "parent_id", *(c.alias(n) for n, c in own.items()))
        if below is not None:
            handed = below.select(F.col("parent_id").alias("node_id"), *((lifted or {}).get(n, F.col(n)).alias(n) for n in own)).groupBy("node_id").agg(*(merge[n](n).alias(f"_{n}") for n in own))
            handed = handed.join(level.select("node_id", "parent_id"), "node_id").select("node_id", "parent_id", *(F.col(f"_{n}").alias(n) for n in own))
            mine = mine.unionByName(handed).groupBy("node_id", "parent_id").agg(*(merge[n](n).alias(n) for n in own))
        below = step(mine)
        done = below if done is None else done.unionByName(below)
    return nodes.select("node_id", *(c.alias(n) for n, c in own.items())).where("false") if done is None else done.drop("parent_id")


def multiply(a: F.Column, b: F.Column) -> F.Column:
    """4x4 matrices by rows, as arrays of 16."""
    return F.array(*(reduce(lambda x, y: x + y, (a[4 * i + k] * b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)))


def cumulative_transforms(nodes: DataFrame, most: int = 64) -> DataFrame:
    """(node_id, world): root * ... * parent * own of each node's transform, level by level."""
    known = step(nodes.where("parent_id is null").select("node_id", F.col("transform").alias("world")))
    level = known
    for _ in range(most):
        below = nodes.join(level.select(F.col("node_id").alias("parent_id"), F.col("world").alias("above")), "parent_id")
        level = step(below.select("node_id", multiply(F.col("above"), F.col("transform")).alias("world")))
        if level.isEmpty():
            return known
        known = step(known.unionByName(level))
    raise RuntimeError("the hierarchy has a cycle")


def remove_subtree(nodes: DataFrame, root) -> DataFrame:
    gone = closure(nodes).where(F.col("ancestor") == root).select("node_id")
    return nodes.join(gone, "node_id", "left_anti")


def leaves(nodes: DataFrame) -> DataFrame:
    """Interior nodes taken out."""
    return nodes.join(nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")), "node_id", "left_anti")


def remove_empty(nodes: DataFrame, points: DataFrame, key: str = "node_id") -> DataFrame:
    """Nodes whose subtree has a point; roots stay."""
    full = closure(nodes).join(points.select(key).distinct(), "node_id", "left_semi").select(F.col("ancestor").alias("node_id")).distinct()
    return nodes.join(full.withColumn("_full", F.lit(True)), "node_id", "left").where(F.col("_full").isNotNull() | F.col("parent_id").isNull()).drop("_full")


def flatten(nodes: DataFrame) -> DataFrame:
    """Every node under the root with its cumulative transform; the root's becomes the identity."""
    root = nodes.where("parent_id is null").select(F.col("node_id").alias("_root"))
    out = nodes.drop("transform", "parent_id").join(cumulative_transforms(nodes), "node_id").crossJoin(F.broadcast(root.limit(1)))
    top = F.col("node_id") == F.col("_root")
    return out.withColumns({"transform": F.when(top, F.array(*(F.lit(float(v)) for v in IDENTITY))).otherwise(F.col("world")), "parent_id": F.when(~top, F.col("_root"))}).drop("world", "_root")
