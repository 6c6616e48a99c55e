"""Constraints on surfels: a row test and a conservative test on block statistics.

A Constraint has `row`, a Column over surfel rows, and `block`, a Column over per-block extents (xmin..zmax, tmin,
tmax) that is false only if no row of the block can pass. scan() prunes with the second, then filters with the first;
over Parquet the row test also reaches the scan as pushed filters wherever it is made of comparisons.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import cos

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EPSILON, FLAG_AERIAL, FLAG_BORDER, FLAG_MARKED, FLAG_SHADOW, FLAG_SILHOUETTE
from ..functions import geometry as G
from ..functions.vec import V3, LaterV3

P, N = LaterV3("x", "y", "z"), LaterV3("nx", "ny", "nz")
LOW, HIGH = LaterV3("xmin", "ymin", "zmin"), LaterV3("xmax", "ymax", "zmax")


@dataclass(frozen=True)
class Constraint:
    row: F.Column
    block: F.Column | None = None

    def __and__(self, other: Constraint) -> Constraint:
        blocks = [b for b in (self.block, other.block) if b is not None]
        return Constraint(self.row & other.row, reduce(lambda a, b: a & b, blocks) if blocks else None)


def all_of(constraints: Sequence[Constraint]) -> Constraint:
    return reduce(lambda a, b: a & b, constraints, Constraint(F.lit(True)))


def box(low: Sequence[float], high: Sequence[float]) -> Constraint:
    a, b = V3.of(*low), V3.of(*high)
    return Constraint(G.in_box(P, a, b), G.boxes_meet(LOW, HIGH, a, b))


def oriented_box(center: Sequence[float], axes: Sequence[Sequence[float]], radii: Sequence[float]) -> Constraint:
    r = sum(radii)
    c = V3.of(*center)
    return Constraint(G.in_oriented_box(P, c, tuple(V3.of(*a) for a in axes), tuple(radii)), G.boxes_meet(LOW, HIGH, V3.of(*(x - r for x in center)), V3.of(*(x + r for x in center))))


def sphere(center: Sequence[float], radius: float) -> Constraint:
    c = V3.of(*center)
    return Constraint(G.in_sphere(P, c, radius), G.point_box(c, LOW, HIGH) <= radius)


def cylinder(center: Sequence[float], radius: float, low: float = -1e300, high: float = 1e300) -> Constraint:
    c = V3.of(*center)
    return Constraint(G.in_cylinder(P, c, radius, low, high), (G.point_box_xy(c, LOW, HIGH) <= radius) & (F.col("zmin") <= high) & (F.col("zmax") >= low))


def halfspace(normal: Sequence[float], d: float) -> Constraint:
    n = V3.of(*normal)
    best = V3(*(F.when(c >= 0, b).otherwise(a) for c, a, b in zip(n, LOW, HIGH, strict=True)))
    return Constraint(G.in_halfspace(P, (n, F.lit(d))), G.point_plane_signed(best, (n, F.lit(d))) >= 0)


def near_line(on: Sequence[float], along: Sequence[float], tolerance: float) -> Constraint:
    return Constraint(G.point_line(P, V3.of(*on), V3.of(*along)) <= tolerance)


def plane_side(normal: Sequence[float], d: float, below: bool, on: bool, above: bool, tolerance: float) -> Constraint:
    """Above: distance > tolerance, on: |distance| <= tolerance, below: distance < tolerance (which takes in `on`'s lower part)."""
    s = G.point_plane_signed(P, (V3.of(*normal), F.lit(d)))
    tests = [t for wanted, t in ((above, s > tolerance), (on, F.abs(s) <= tolerance), (below, s < tolerance)) if wanted]
    return Constraint(reduce(lambda a, b: a | b, tests, F.lit(False)))


def coordinate(axis: str, low: float, high: float, eps: float = EPSILON) -> Constraint:
    return Constraint(F.col(axis).between(low - eps, high + eps), (F.col(f"{axis}min") <= high + eps) & (F.col(f"{axis}max") >= low - eps))


def normal(direction: Sequence[float], angle: float) -> Constraint:
    return Constraint(N.dot(V3.of(*direction)) >= cos(angle))


def timestamp(low: float, high: float) -> Constraint:
    """A closed interval; an empty one lets every row pass."""
    if low > high:
        return Constraint(F.lit(True))
    return Constraint(F.col("timestamp").between(low, high), (F.col("tmin") <= high) & (F.col("tmax") >= low))


def elevation(low: float, high: float, eps: float = EPSILON) -> Constraint:
    return Constraint(F.col("elevation").between(low - eps, high + eps))


def of_object(object_id: int | None, converse: bool = False) -> Constraint:
    """None: any object."""
    test = F.col("object_id").isNotNull() if object_id is None else F.col("object_id").eqNullSafe(F.lit(object_id))
    return Constraint(~test if converse else test)


def of_label(label: str | None, converse: bool = False, column: str = "label") -> Constraint:
    """Over rows with their current label; None: any label."""
    test = F.col(column).isNotNull() if label is None else F.col(column).eqNullSafe(F.lit(label))
    return Constraint(~test if converse else test)


def source(aerial: bool, terrestrial: bool) -> Constraint:
    bit = F.col("flags").bitwiseAND(FLAG_AERIAL) != 0
    return Constraint((bit & aerial) | (~bit & terrestrial))


def boundary(interior: bool, border: bool, silhouette: bool, shadow: bool) -> Constraint:
    kind = F.col("flags").bitwiseAND(FLAG_BORDER)
    wanted = [v for take, v in ((interior, 0), (border, FLAG_BORDER), (silhouette, FLAG_SILHOUETTE), (shadow, FLAG_SHADOW)) if take]
    return Constraint(kind.isin(wanted) if wanted else F.lit(False))


def mark(marked: bool, unmarked: bool) -> Constraint:
    bit = F.col("flags").bitwiseAND(FLAG_MARKED) != 0
    return Constraint((bit & marked) | (~bit & unmarked))


COMPARE: dict[str, Callable[[F.Column, F.Column, float], F.Column]] = {
    "Equal": lambda a, b, e: F.abs(a - b) <= e,
    "NotEqual": lambda a, b, e: F.abs(a - b) > e,
    "Greater": lambda a, b, e: a - b > e,
    "GreaterOrEqual": lambda a, b, e: a - b >= -e,
    "Less": lambda a, b, e: b - a > e,
    "LessOrEqual": lambda a, b, e: b - a >= -e,
}


def overhead_grid(points: DataFrame, cells: DataFrame, comparison: str, surfel_value: F.Column, grid_value: float | None, eps: float, x: F.Column, y: F.Column) -> DataFrame:
    """Points whose value compares with a raster under them (bilinear, unknown cells fail). x, y: grid coordinates."""
    from .grid import sample2

    found = sample2(points, cells, x, y, "under")
    other = F.col("under") if grid_value is None else F.lit(grid_value)
    return found.where(F.col("under").isNotNull() & COMPARE[comparison](surfel_value, other, eps)).drop("under")


def in_view(eye: Sequence[float], towards: Sequence[float], up: Sequence[float], width: int, height: int, fx: float, fy: float, near: float, far: float) -> Constraint:
    """Depth between near and far, and the truncated pixel inside the image."""
    t, u = V3.of(*towards), V3.of(*up)
    d = P.minus(V3.of(*eye))
    depth = d.dot(t)
    right = t.cross(u)
    px = F.try_divide(d.dot(right) * fx, depth) + width / 2
    py = F.try_divide(d.dot(u) * fy, depth) + height / 2
    return Constraint(F.coalesce((depth > 0) & depth.between(near, far) & (px >= 0) & (px < width) & (py >= 0) & (py < height), F.lit(False)))


def block_stats(points: DataFrame, key: str = "block_id") -> DataFrame:
    """Extents, identifier range, flags and resolution of each block: one aggregation with partial sums."""
    lo_hi = [f(c).alias(f"{c}{n}") for c in ("x", "y", "z") for f, n in ((F.min, "min"), (F.max, "max"))]
    out = points.groupBy(key).agg(F.count("*").alias("n"), *lo_hi, F.min("timestamp").alias("tmin"), F.max("timestamp").alias("tmax"), F.min("surfel_id").alias("min_id"), F.max("surfel_id").alias("max_id"), F.bit_or("flags").alias("flags"))
    size = [F.col(f"{c}max") - F.col(f"{c}min") for c in ("x", "y", "z")]
    area = F.try_divide(size[0] * size[1] * size[2], F.least(*size))
    return out.withColumn("resolution", F.coalesce(F.sqrt(F.try_divide(F.col("n"), area)), F.lit(0.0)))


def scan(points: DataFrame, constraint: Constraint, blocks: DataFrame | None = None) -> DataFrame:
    """Rows that pass. With block statistics, blocks that can't pass are left out by a semi-join before the row test."""
    if blocks is not None and constraint.block is not None:
        points = points.join(blocks.where(constraint.block).select("block_id"), "block_id", "left_semi")
    return points.where(constraint.row)
