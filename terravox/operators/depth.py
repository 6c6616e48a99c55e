"""Depth images as tables (image_id, ix, iy, depth): positions, normals, boundaries, holes; contours and surfaces of grids."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import V3
from .grid import V, axes_of, cell_of

KEY = ["image_id", "ix", "iy"]


def positions(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Camera coordinates of pixels with a depth; pixels without one stay, with nulls."""
    d = F.when(F.col("depth") > 0, F.col("depth"))
    return pixels.withColumns({"x": (F.col("ix") - cx) * d / fx, "y": (F.col("iy") - cy) * d / fy, "z": -d})


def _beside(column: str, axis: str, step: int) -> F.Column:
    other = "iy" if axis == "ix" else "ix"
    w = Window.partitionBy("image_id", other).orderBy(axis).rangeBetween(step, step)
    return F.first(column).over(w)


def normals(pixels: DataFrame) -> DataFrame:
    """Unit cross product of the differences between neighbours right/left and above/below, where all four are known."""
    d = {f"{c}{n}": _beside(c, a, s) for c in "xyz" for n, (a, s) in {"r": ("ix", 1), "l": ("ix", -1), "u": ("iy", 1), "d": ("iy", -1)}.items()}
    p = pixels.withColumns(d)
    at = lambda n: V3.of(*(f"{c}{n}" for c in "xyz"))
    n = at("r").minus(at("l")).cross(at("u").minus(at("d")))
    p = p.withColumns({"n0": n.x, "n1": n.y, "n2": n.z}).drop(*d)
    size = F.sqrt(F.col("n0") * F.col("n0") + F.col("n1") * F.col("n1") + F.col("n2") * F.col("n2"))
    return p.withColumns({f"n{c}": F.try_divide(F.col(f"n{i}"), size) for i, c in enumerate("xyz")}).drop("n0", "n1", "n2")


def boundaries(pixels: DataFrame, threshold: float = 0.1, least: float = 0.1) -> DataFrame:
    """1 (silhouette) where the depth jumps back to one of the four neighbours by more than max(least, depth * threshold), 2 (shadow) where it jumps forward, 0 elsewhere."""
    jumps = [_beside("depth", a, s) - F.col("depth") for a in ("ix", "iy") for s in (-1, 1)]
    limit = F.greatest(F.lit(least), F.col("depth") * threshold)
    back, front = F.greatest(*(F.coalesce(j, F.lit(0.0)) for j in jumps)), F.least(*(F.coalesce(j, F.lit(0.0)) for j in jumps))
    return pixels.withColumns({"_b": back, "_f": front}).withColumn("boundary", F.when(F.col("_b") > limit, 1).when(-F.col("_f") > limit, 2).otherwise(0)).drop("_b", "_f")


def fill_zero_runs(cells: DataFrame, most: int) -> DataFrame:
    """3D holes: runs of zeros shorter than `most` between nonzero cells get linear values, along z, y, then x."""
    out = cells
    for axis in ("iz", "iy", "ix"):
        others = [c for c in cell_of(cells) if c != axis]
        w = Window.partitionBy(*others).orderBy(axis)
        on = F.when(V != 0, F.struct(F.col(axis).alias("i"), V.alias("v")))
        before, after = F.last(on, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(on, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        t = F.try_divide(F.col(axis) - F.col("_b.i"), F.col("_a.i") - F.col("_b.i"))
        filled = F.when((V == 0) & (F.col("_a.i") - F.col("_b.i") - 1 < most), F.col("_b.v") + t * (F.col("_a.v") - F.col("_b.v")))
        out = out.withColumns({"_b": before, "_a": after}).withColumn("value", F.coalesce(filled, V)).drop("_b", "_a")
    return out


def contours(cells: DataFrame, level: float) -> DataFrame:
    """(grid_id, ix, iy, x0, y0, x1, y1): segments of the isoline in each triangle of each square of known cells."""
    q = cells.where(V.isNotNull()).select(*cell_of(cells), V.alias("h00"))
    for dx, dy in ((1, 0), (0, 1), (1, 1)):
        q = q.join(cells.where(V.isNotNull()).select("grid_id", (F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), V.alias(f"h{dx}{dy}")), cell_of(cells))
    triangles = [((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1))]
    cut = []
    for t in triangles:
        ends = []
        for (ax, ay), (bx, by) in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            a, b = F.col(f"h{ax}{ay}"), F.col(f"h{bx}{by}")
            s = F.try_divide(level - a, b - a)
            ends.append(F.when((a > level) != (b > level), F.struct((F.col("ix") + ax + s * (bx - ax)).alias("x"), (F.col("iy") + ay + s * (by - ay)).alias("y"))))
        cut.append(F.filter(F.array(*ends), lambda e: e.isNotNull()))
    rows = q.select("grid_id", "ix", "iy", F.explode(F.array(*cut)).alias("p")).where(F.size("p") == 2)
    return rows.select("grid_id", "ix", "iy", F.col("p")[0]["x"].alias("x0"), F.col("p")[0]["y"].alias("y0"), F.col("p")[1]["x"].alias("x1"), F.col("p")[1]["y"].alias("y1"))


#: Six tetrahedra that share the diagonal 000-111 of a cube; corners as (x, y, z).
TETRAHEDRA = tuple(((0, 0, 0), *path, (1, 1, 1)) for path in (((1, 0, 0), (1, 1, 0)), ((1, 0, 0), (1, 0, 1)), ((0, 1, 0), (1, 1, 0)), ((0, 1, 0), (0, 1, 1)), ((0, 0, 1), (1, 0, 1)), ((0, 0, 1), (0, 1, 1))))


def isosurface(cells: DataFrame, level: float) -> DataFrame:
    """(grid_id, ix, iy, iz, k, corners): polygons (3 or 4 points) where the surface cuts each tetrahedron of each cube.

    A tetrahedron's crossing edges, of six, are its polygon's corners; with four they are put in order round it."""
    known = cells.where(V.isNotNull())
    q = known.select(*cell_of(cells), V.alias("h000"))
    for o in list(product((0, 1), repeat=3))[1:]:
        name = "h" + "".join(map(str, o))
        q = q.join(known.select("grid_id", *((F.col(a) - d).alias(a) for a, d in zip(axes_of(cells), o, strict=True)), V.alias(name)), cell_of(cells))
    q = q.where((F.greatest(*(F.col("h" + "".join(map(str, o))) for o in product((0, 1), repeat=3))) > level) & (F.least(*(F.col("h" + "".join(map(str, o))) for o in product((0, 1), repeat=3))) <= level))
    polygons = []
    for t in TETRAHEDRA:
        h = [F.col("h" + "".join(map(str, c))) for c in t]
        # round the polygon: edges 01, 02, 32, 31 and 03, 12 between them where they cross
        points = []
        for i, j in ((0, 1), (0, 2), (0, 3), (3, 2), (3, 1), (1, 2)):
            s = F.try_divide(level - h[i], h[j] - h[i])
            points.append(F.when((h[i] > level) != (h[j] > level), F.array(*(F.col(a) + t[i][n] + s * (t[j][n] - t[i][n]) for n, a in enumerate(axes_of(cells))))))
        polygons.append(F.filter(F.array(*points), lambda e: e.isNotNull()))
    rows = q.select(*cell_of(cells), F.posexplode(F.array(*polygons)).alias("k", "corners"))
    return rows.where(F.size("corners") >= 3)


def greedy_maxima(cells: DataFrame, n: int, spacing: float, candidates: int = 100_000) -> DataFrame:
    """Up to n cells in falling order of value, none nearer than `spacing` to one before it; ties to the smaller index.

    Each choice removes a ball. The largest `candidates` cells outside all balls so far are gone through on the driver,
    again and again until n are found or no cell is left; n must stay well below that number."""
    if n * 10 > candidates:
        raise ValueError("n must be at most a tenth of the candidates")
    axes = axes_of(cells)
    known, schema = cells.where(V.isNotNull()).select(*axes, "value"), ", ".join(f"{a} int" for a in axes) + ", value double"
    chosen: list = []
    outside = known
    while len(chosen) < n:
        rows = outside.orderBy(F.desc("value"), *axes).limit(candidates).collect()
        for r in rows:
            if len(chosen) == n:
                break
            if all(sum((r[a] - c[a]) ** 2 for a in axes) >= spacing * spacing for c in chosen):
                chosen.append(r)
        if len(rows) < candidates:
            break
        balls = cells.sparkSession.createDataFrame(chosen, schema).select(*(F.col(a).alias(f"{a}_c") for a in axes))
        d2 = sum(((F.col(a) - F.col(f"{a}_c")).cast("double") * (F.col(a) - F.col(f"{a}_c")) for a in axes), F.lit(0.0))
        outside = known.join(F.broadcast(balls), d2 < spacing * spacing, "left_anti")
    return cells.sparkSession.createDataFrame(chosen, schema)


def scan_grid(points: DataFrame, column: str, rows: str, columns: str, key: Sequence[str] = ()) -> DataFrame:
    """A scan as a raster: the mean of an attribute for each (beam, scanline)."""
    return points.groupBy(*key, F.col(rows).alias("iy"), F.col(columns).alias("ix")).agg(F.avg(column).alias("value"))
