"""Per-object features, support heights, hulls and molecules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import hull
from .spatial_join import range_pairs


def object_features(points: DataFrame, key: str = "object_id") -> DataFrame:
    """Height, mean height above the lowest point, deviation of height, largest ground radius and ground extents along the principal axes.

    Two aggregations: sums for the centroid and covariance, then the radius from the centroid."""
    sums = points.groupBy(key).agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.avg("z").alias("zm"), F.stddev_pop("z").alias("zs"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    half, diff = (F.col("vx") + F.col("vy")) / 2, (F.col("vx") - F.col("vy")) / 2
    root = F.sqrt(diff * diff + F.col("vxy") * F.col("vxy"))
    d = lambda: F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))
    radius = points.join(sums.select(key, "mx", "my"), key).groupBy(key).agg(F.max(d()).alias("radius"))
    out = sums.join(radius, key)
    return out.select(key, (F.col("z1") - F.col("z0")).alias("height"), (F.col("zm") - F.col("z0")).alias("mean_height"), F.col("zs").alias("deviation"), "radius", F.sqrt(half + root).alias("extent0"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("extent1"))


def support_height(points: DataFrame, key: str, cell: float) -> DataFrame:
    """The height level with most votes: a histogram of heights, smoothed by [1/4, 1/2, 1/4]; the lowest of equals."""
    votes = points.groupBy(key, F.floor(F.col("z") / cell).alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("level").rangeBetween(-1, 1)
    near = F.sum("n").over(w)
    smooth = votes.withColumn("score", 0.25 * near + 0.25 * F.col("n"))
    best = smooth.groupBy(key).agg(F.max_by("level", F.struct("score", -F.col("level"))).alias("level"))
    return best.select(key, ((F.col("level") + 0.5) * cell).alias("z"))


def convex_hulls(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, n, x, y) corners in order. Each task first keeps only the corners of its own points, so the final groups are small."""
    own = points.select(F.col(key).cast("long").alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [pd.DataFrame(hull(g[["x", "y"]].to_numpy()), columns=["x", "y"]).assign(k=k) for k, g in pdf.groupby("k")]
            if parts:
                yield pd.concat(parts)[["k", "x", "y"]]

    def final(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"k": group[0], "n": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return own.mapInPandas(partial, "k long, x double, y double").groupBy("k").applyInPandas(final, "k long, n long, x double, y double").withColumnRenamed("k", key)


def bonds(atoms: DataFrame, most: float, ident: str = "serial", slack: str | None = None) -> DataFrame:
    """Pairs of atoms a < b within a distance; with radii given, the gap between their surfaces counts."""
    carry = (slack,) if slack else ()
    reach = most + (2 * (atoms.agg(F.max(slack)).first()[0] or 0.0) if slack else 0.0)
    pairs = range_pairs(atoms, atoms, reach, ident=ident, carry=carry).where("query_id < point_id")
    gap = F.greatest(F.lit(0.0), F.col("distance") - F.col(f"q{slack}") - F.col(f"p{slack}")) if slack else F.col("distance")
    return pairs.select(F.col("query_id").alias("a"), F.col("point_id").alias("b"), gap.alias("gap")).where(F.col("gap") <= most)
