"""Clustering: k-means, agglomeration on a neighbour graph, region growing, mean shift, boundary refinement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, step

AXES = ("x", "y", "z")


def kmeans(points: DataFrame, k: int, rounds: int = 20, seed: int = 1, ident: str = "surfel_id", axes: Sequence[str] = AXES) -> DataFrame:
    """(id, cluster) by Lloyd's iteration from k points drawn by hash. Centres are k rows on the driver; each round is one aggregation."""
    centres = np.array(points.orderBy(F.xxhash64(F.col(ident), F.lit(seed))).select(*axes).limit(k).toPandas(), np.float64)
    label = _nearest(centres, axes)
    for _ in range(rounds):
        rows = points.groupBy(label.alias("cluster")).agg(*(F.avg(a).alias(a) for a in axes)).toPandas()
        new = centres.copy()
        new[rows["cluster"]] = rows[list(axes)].to_numpy(np.float64)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres, label = new, _nearest(new, axes)
    return points.select(ident, label.alias("cluster"))


def _nearest(centres: np.ndarray, axes: Sequence[str]) -> F.Column:
    d = [F.struct(sum(((F.col(a) - float(v)) * (F.col(a) - float(v)) for a, v in zip(axes, c, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*d))["i"]


def affinity(distance: F.Column, normal_angle: F.Column | None, max_distance: float, max_angle: float = 0.0, most_lost: float = 1.0) -> F.Column:
    """Product of (1 - lost d / max) factors, 0 beyond any maximum."""
    out = F.when(distance > max_distance, 0.0).otherwise(1 - most_lost * distance / max_distance)
    if normal_angle is not None and max_angle > 0:
        out = out * F.when(normal_angle > max_angle, 0.0).otherwise(1 - most_lost * normal_angle / max_angle)
    return out


def region_growing(edges: DataFrame, least: float) -> DataFrame:
    """(node, component): regions joined by edges (a, b, affinity) of at least this affinity, each named by its smallest node; a node without such an edge is in none."""
    others = components(edges.where(F.col("affinity") >= least).select("a", "b"))
    return others.union(others.select(F.col("component").alias("node"), "component").distinct())


def agglomerate(points: DataFrame, edges: DataFrame, max_distance: float, least: float = 0.1, ident: str = "surfel_id", rounds: int = 1_000) -> DataFrame:
    """(id, cluster): clusters merge with their best neighbour as long as the affinity of their centroids allows.

    Each round every cluster picks its best neighbour (ties to the smaller one) and pairs that pick each other merge, so
    all regions merge at once, until no pair does; the best pair of all always merges, so that comes to an end. `rounds`
    is a bound for safety. edges: (a, b) of the neighbour graph."""
    label = step(points.select(ident, F.col(ident).alias("cluster")))
    position = points.select(ident, *AXES)
    for _ in range(rounds):
        centre = position.join(label, ident).groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in AXES))
        l0, l1 = label.select(F.col(ident).alias("a"), F.col("cluster").alias("ca")), label.select(F.col(ident).alias("b"), F.col("cluster").alias("cb"))
        touching = edges.join(l0, "a").join(l1, "b").where("ca <> cb").select("ca", "cb").distinct()
        both = touching.union(touching.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct()
        c0, c1 = (centre.select(F.col("cluster").alias(c), *(F.col(a).alias(f"{c}{a}") for a in AXES)) for c in ("ca", "cb"))
        d = F.sqrt(sum(((F.col(f"ca{a}") - F.col(f"cb{a}")) * (F.col(f"ca{a}") - F.col(f"cb{a}")) for a in AXES), F.lit(0.0)))
        scored = both.join(c0, "ca").join(c1, "cb").select("ca", "cb", affinity(d, None, max_distance).alias("s")).where(F.col("s") >= least)
        best = scored.groupBy("ca").agg(F.max_by("cb", F.struct("s", -F.least("ca", "cb"), -F.greatest("ca", "cb"))).alias("cb"))
        other = best.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))
        merged = step(best.join(other, ["ca", "cb"], "left_semi").where("ca > cb"))
        if merged.isEmpty():
            return label
        label = step(label.join(merged, F.col("cluster") == F.col("ca"), "left").select(ident, F.coalesce("cb", "cluster").alias("cluster")))
    raise RuntimeError(f"clusters still merge after {rounds} rounds")


def merge_small(labels: DataFrame, least: int, ident: str = "surfel_id") -> DataFrame:
    """All clusters with fewer points become one, named by the smallest of them."""
    size = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    first = size.where(F.col("n") < least).agg(F.min("cluster").alias("first"))
    out = labels.join(size, "cluster").crossJoin(F.broadcast(first))
    return out.select(ident, F.when(F.col("n") < least, F.col("first")).otherwise(F.col("cluster")).alias("cluster"))


def keep_largest(labels: DataFrame, most: int) -> DataFrame:
    """Points of the clusters with most points, ties to the smaller name."""
    top = labels.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(most)
    return labels.join(F.broadcast(top.select("cluster")), "cluster", "left_semi")


def refine(labels: DataFrame, edges: DataFrame, ident: str = "surfel_id") -> DataFrame:
    """Each point takes the cluster that more than half of its neighbours have, if there is one. edges: (a, b) both ways."""
    near = edges.join(labels.select(F.col(ident).alias("b"), "cluster"), "b").groupBy("a", "cluster").agg(F.count("*").alias("n"))
    best = near.groupBy("a").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("to"), F.max("n").alias("n"), F.sum("n").alias("all"))
    out = labels.join(best, F.col(ident) == F.col("a"), "left")
    return out.select(ident, F.when(2 * F.col("n") > F.col("all"), F.col("to")).otherwise(F.col("cluster")).alias("cluster"))


def mean_shift(cells: DataFrame, resolution: Sequence[int], rounds: int = 200) -> DataFrame:
    """(grid_id, ix, iy, iz, cluster): where each cell's 5x5x5 Gaussian-weighted mean shift comes to rest, clamped to the grid.

    A grid is whole in one task, as the flow may cross all of it; grids run side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = tuple(resolution)
        v = np.zeros(shape)
        v[pdf["ix"], pdf["iy"], pdf["iz"]] = np.maximum(pdf["value"], 0)
        at = np.indices(shape).reshape(3, -1).T
        total, weight = np.zeros((len(at), 3)), np.zeros(len(at))
        for o in np.ndindex(5, 5, 5):
            near = at + np.array(o) - 2
            inside = ((near >= 0) & (near < shape)).all(axis=1)
            w = np.zeros(len(at))
            w[inside] = v[tuple(near[inside].T)] * np.exp(-((np.array(o) - 2) ** 2).sum() / 2)
            total += w[:, None] * near
            weight += w
        mean = np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-300)[:, None], at)
        to = np.clip((mean + 0.5).astype(int), 0, np.array(shape) - 1)
        flow = np.ravel_multi_index(tuple(to.T), shape)
        for _ in range(rounds):
            after = np.minimum(flow, flow[flow]) if (flow[flow[flow]] == flow).all() else flow[flow]  # a cycle of two ends at its smaller cell
            if (after == flow).all():
                break
            flow = after
        return pdf[["grid_id", "ix", "iy", "iz"]].assign(cluster=flow[np.ravel_multi_index((pdf["ix"], pdf["iy"], pdf["iz"]), shape)].astype("int64"))

    return cells.groupBy("grid_id").applyInPandas(run, "grid_id int, ix int, iy int, iz int, cluster long")
