"""Sampling that can be repeated: draws are hashes of identifiers and a seed, so retried tasks draw the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import V3
from .mesh import area, at, corners


def uniform(*key: F.Column | str, seed: int = 1) -> F.Column:
    """A number in [0, 1) from the hash of some columns."""
    return F.pmod(F.xxhash64(*(F.col(k) if isinstance(k, str) else k for k in key), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def bernoulli(points: DataFrame, p: F.Column | float, ident: str = "surfel_id", seed: int = 1) -> DataFrame:
    return points.where(uniform(ident, seed=seed) < p)


def levels(points: DataFrame, blocks: DataFrame, target: float, ident: str = "surfel_id", seed: int = 1) -> DataFrame:
    """Low-resolution copies: each block keeps its rows with probability target / resolution."""
    p = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(target), F.col("resolution")), F.lit(1.0)))
    return points.join(blocks.select("block_id", "resolution"), "block_id").where(uniform(ident, seed=seed) < p).drop("resolution")


def exactly(points: DataFrame, n: int, ident: str = "surfel_id", seed: int = 1) -> DataFrame:
    """n rows with the smallest hashes: a top-k, no sort of the table."""
    return points.orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident).limit(n)


def surface(vertices: DataFrame, faces: DataFrame, density: float, seed: int = 1) -> DataFrame:
    """(face_id, k, x, y, z): area x density points of each face, the fraction rounded by chance, uniform inside."""
    c = corners(vertices, faces).withColumn("want", area() * density)
    n = F.floor("want") + (uniform("face_id", seed=seed) < F.col("want") - F.floor("want")).cast("long")
    drawn = c.withColumn("n", n).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    r, s = F.sqrt(uniform("face_id", "k", seed=seed + 1)), uniform("face_id", "k", seed=seed + 2)
    p = at(0).times(1 - r).plus(at(1).times(r * (1 - s))).plus(at(2).times(r * s))
    return drawn.select("face_id", "k", *V3(*p).named())
