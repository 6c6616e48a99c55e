"""Fits and alignments. Points are reduced to a few sums on the executors; the driver solves a 3 x 3 problem."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, pi, sin

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial_join import closest

AXES = ("x", "y", "z")


def centroid(points: DataFrame, weight: F.Column | None = None, key: Sequence[str] = ()) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return points.groupBy(*key).agg(*((F.sum(w * F.col(a)) / F.sum(w)).alias(f"c{a}") for a in AXES))


def moments(points: DataFrame, weight: F.Column | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Count, centroid and covariance (over the total weight): one pass of partial sums."""
    w = F.lit(1.0) if weight is None else weight
    mean = {a: F.sum(w * F.col(a)) / F.sum(w) for a in AXES}
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return points.groupBy(*key).agg(F.count("*").alias("n"), *(mean[a].alias(f"c{a}") for a in AXES), *((F.sum(w * F.col(a) * F.col(b)) / F.sum(w) - mean[a] * mean[b]).alias(f"{a}{b}") for a, b in pairs))


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    c = np.array([[row[min(a, b) + max(a, b)] for b in AXES] for a in AXES], np.float64)
    return np.array([row[f"c{a}"] for a in AXES], np.float64), c


def principal_axes(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, axes by rows from the largest variance down, and variances.

    The first two axes point to where more points lie (by the dot product with raw positions); the third is their cross product."""
    mean, c = _matrix(moments(points).first())
    values, vectors = np.linalg.eigh(c)
    axes = vectors.T[::-1].copy()
    votes = points.agg(*(F.sum(F.signum(sum((F.col(a) * float(v) for a, v in zip(AXES, axes[i], strict=True)), F.lit(0.0)))).alias(f"v{i}") for i in range(2))).first()
    for i in range(2):
        if (votes[i] or 0) < 0:
            axes[i] = -axes[i]
    axes[2] = np.cross(axes[0], axes[1])
    return mean, axes, values[::-1]


def fit_plane(points: DataFrame) -> tuple[np.ndarray, float]:
    """Normal and d of the least-squares plane normal . p + d = 0, the normal turned up."""
    mean, axes, _ = principal_axes(points)
    n = axes[2] if axes[2][2] >= 0 else -axes[2]
    return n, -float(n @ mean)


def oriented_boxes(points: DataFrame, key: str = "object_id", steps: int = 16) -> DataFrame:
    """For each object the box of least volume over rotations about z in [0, 90) degrees; axis 0 is the longer side. One aggregation."""
    turns = [(i * pi / 2 / steps) for i in range(steps)]
    u = [F.col("x") * cos(t) + F.col("y") * sin(t) for t in turns]
    v = [F.col("y") * cos(t) - F.col("x") * sin(t) for t in turns]
    ends = points.groupBy(key).agg(F.min("z").alias("z0"), F.max("z").alias("z1"), *(f(c[i]).alias(f"{n}{e}{i}") for i in range(steps) for n, c in (("u", u), ("v", v)) for e, f in ((0, F.min), (1, F.max))))
    boxes = F.array(*(F.struct(((F.col(f"u1{i}") - F.col(f"u0{i}")) * (F.col(f"v1{i}") - F.col(f"v0{i}")) * (F.col("z1") - F.col("z0"))).alias("volume"), F.lit(t).alias("angle"), ((F.col(f"u1{i}") - F.col(f"u0{i}")) / 2).alias("r0"), ((F.col(f"v1{i}") - F.col(f"v0{i}")) / 2).alias("r1")) for i, t in enumerate(turns)))
    best = ends.select(key, F.array_min(boxes).alias("b"), ((F.col("z1") - F.col("z0")) / 2).alias("r2"))
    turned = F.col("b.r1") > F.col("b.r0")
    return best.select(key, "b.volume", F.when(turned, F.col("b.angle") + pi / 2).otherwise(F.col("b.angle")).alias("angle"), F.greatest("b.r0", "b.r1").alias("r0"), F.least("b.r0", "b.r1").alias("r1"), "r2")


def similarity(pairs: DataFrame, scale: bool = False) -> np.ndarray:
    """The 4x4 matrix that takes (x, y, z) to (u, v, w) best in least squares: rotation, optional scale, translation."""
    to = ("u", "v", "w")
    s = pairs.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in (*AXES, *to)), *(F.avg(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in AXES for b in to), F.avg(sum((F.col(a) * F.col(a) for a in AXES), F.lit(0.0))).alias("xx")).first()
    p, q = np.array([s[f"m{a}"] for a in AXES]), np.array([s[f"m{b}"] for b in to])
    h = np.array([[s[f"{a}{b}"] for b in to] for a in AXES]) - np.outer(p, q)
    left, values, right = np.linalg.svd(h)
    sign = np.diag([1, 1, np.sign(np.linalg.det(right.T @ left.T)) or 1])
    r = right.T @ sign @ left.T
    k = float((values * np.diag(sign)).sum() / max(s["xx"] - p @ p, 1e-300)) if scale else 1.0
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = k * r, q - k * r @ p
    return out


def moved(points: DataFrame, m: np.ndarray) -> DataFrame:
    row = lambda i: F.col("x") * float(m[i, 0]) + F.col("y") * float(m[i, 1]) + F.col("z") * float(m[i, 2]) + float(m[i, 3])
    return points.withColumns({a: row(i) for i, a in enumerate(AXES)})


def rmsd(pairs: DataFrame) -> float:
    d2 = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(AXES, ("u", "v", "w"), strict=True)), F.lit(0.0))
    return float(pairs.agg(F.sqrt(F.avg(d2))).first()[0] or 0.0)


def icp(source: DataFrame, target: DataFrame, ident: str = "surfel_id", rounds: int = 128, most: float = float("inf"), eps: float = 1e-9) -> tuple[np.ndarray, float]:
    """Nearest neighbours, least squares, again, until the error stops falling; the matrix and the last error."""
    total, error = np.eye(4), float("inf")
    to = target.select(F.col(ident).alias("point_id"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"))
    for _ in range(rounds):
        now = moved(source, total)
        pairs = closest(now, target, ident, most=most).join(to, "point_id").join(now.select(F.col(ident).alias("query_id"), *AXES), "query_id").persist()
        step = similarity(pairs)
        after = rmsd(moved(pairs, step))
        pairs.unpersist()
        if after >= error - eps:
            return total, error
        total, error = step @ total, after
    return total, error


def ransac_plane(points: DataFrame, tolerance: float, tries: int = 64, seed: int = 1, ident: str = "surfel_id") -> tuple[np.ndarray, float, int]:
    """Normal, d and inliers of the best of `tries` planes through three points, refitted to its inliers.

    Points are drawn by the hash of their id, so a run can be repeated; all planes are counted in one pass."""
    drawn = points.orderBy(F.xxhash64(F.col(ident), F.lit(seed))).select(*AXES).limit(3 * tries).toPandas().to_numpy(np.float64)
    planes = []
    for i in range(0, len(drawn) - 2, 3):
        n = np.cross(drawn[i + 1] - drawn[i], drawn[i + 2] - drawn[i])
        if np.linalg.norm(n) > 1e-12:
            n = n / np.linalg.norm(n)
            planes.append((*n, -float(n @ drawn[i])))
    near = lambda p: F.abs(F.col("x") * p[0] + F.col("y") * p[1] + F.col("z") * p[2] + p[3]) <= tolerance
    planes = [tuple(map(float, p)) for p in planes]
    counts = points.agg(*(F.count_if(near(p)).alias(f"c{i}") for i, p in enumerate(planes))).first()
    best = planes[int(np.argmax(list(counts)))]
    n, d = fit_plane(points.where(near(best)))
    return n, d, points.where(near((*map(float, n), d))).count()
