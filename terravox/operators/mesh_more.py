"""Measures at edges and vertices of a mesh, movements of vertices, and geodesic neighbourhoods of vertex properties."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import V3
from .graph import shortest_paths, step
from .mesh import area, at, corners, edge_lengths, edges, normal, smooth

XYZ = ("x", "y", "z")


def _vec(prefix: str) -> V3:
    return V3.of(*(f"{prefix}{c}" for c in XYZ))


def _unit_or_zero(v: V3, names: Sequence[str]) -> list[F.Column]:
    length = v.norm()
    return [F.when(length > 0, c / length).otherwise(F.lit(0.0)).alias(n) for c, n in zip(v, names, strict=True)]


def sides(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v0, v1, faces, f0, f1, o0, o1) once an edge: its faces by number and the vertices across them, with positions ax..az of v0, bx..bz of v1."""
    half = F.explode(F.array(*(F.struct(F.least(a, b).alias("v0"), F.greatest(a, b).alias("v1"), F.col(c).alias("o")) for a, b, c in (("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1")))))
    own = faces.select("face_id", half.alias("e")).select("face_id", "e.*").groupBy("v0", "v1")
    e = own.agg(F.count("*").alias("faces"), F.min("face_id").alias("f0"), F.max("face_id").alias("f1"), F.min_by("o", "face_id").alias("o0"), F.max_by("o", "face_id").alias("o1"))
    return _placed(_placed(e, vertices, "v0", "a"), vertices, "v1", "b")


def _placed(rows: DataFrame, vertices: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.join(vertices.select(F.col("vertex_id").alias(key), *(F.col(c).alias(f"{prefix}{c}") for c in XYZ)), key)


def edge_directions(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v0, v1, dx, dy, dz): unit vector from v0 to v1, zero for an edge without length."""
    along = _vec("b").minus(_vec("a"))
    return sides(vertices, faces).select("v0", "v1", *_unit_or_zero(along, ("dx", "dy", "dz")))


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return corners(vertices, faces).select("face_id", *(f"v{k}" for k in range(3)), *normal().named("nx", "ny", "nz"))


def edge_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v0, v1, nx, ny, nz): unit sum of the normals of the faces at an edge."""
    n = face_normals(vertices, faces)
    side = F.explode(F.array(*(F.struct(F.least(a, b).alias("v0"), F.greatest(a, b).alias("v1")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    total = n.select(side.alias("e"), "nx", "ny", "nz").groupBy("e.v0", "e.v1").agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in XYZ))
    return total.select("v0", "v1", *_unit_or_zero(_vec("s"), ("nx", "ny", "nz")))


def edge_aspects(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v0, v1, aspect): distance of the vertices across both faces over the edge's length; 0 on the boundary, infinite for an edge without length."""
    s = sides(vertices, faces)
    across = _placed(_placed(s.where("faces > 1").select("v0", "v1", "o0", "o1"), vertices, "o0", "p"), vertices, "o1", "q").select("v0", "v1", G.point_point(_vec("p"), _vec("q")).alias("across"))
    length = G.point_point(_vec("a"), _vec("b"))
    both = s.withColumn("length", length).join(across, ["v0", "v1"], "left")
    return both.select("v0", "v1", F.when(F.col("across").isNull(), 0.0).when(F.col("length") <= 0, float("inf")).otherwise(F.col("across") / F.col("length")).alias("aspect"))


def vertex_edge_lengths(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(vertex_id, valence, length): number and mean length of the edges at each vertex that has one."""
    e = edge_lengths(vertices, edges(faces).select("v0", "v1"))
    return e.select(F.explode(F.array("v0", "v1")).alias("vertex_id"), "length").groupBy("vertex_id").agg(F.count("*").alias("valence"), F.avg("length").alias("length"))


def averages(vertices: DataFrame, faces: DataFrame, angles: DataFrame) -> DataFrame:
    """One row: mean valence of the vertices, mean length of the edges, mean of the edges' dihedral angles(v0, v1, angle)."""
    e = edge_lengths(vertices, edges(faces).select("v0", "v1")).agg(F.avg("length").alias("edge_length"), F.count("*").alias("n"))
    v, a = vertices.agg(F.count("*").alias("m")), angles.agg(F.avg("angle").alias("edge_angle"))
    one = e.crossJoin(F.broadcast(v)).crossJoin(F.broadcast(a))  # three rows of one
    return one.select(F.try_divide(2 * F.col("n"), F.col("m")).alias("valence"), "edge_length", "edge_angle")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(vertex_id, nx, ny, nz): unit sum of the unit normals of the faces around."""
    n = face_normals(vertices, faces)
    total = n.select(F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), "nx", "ny", "nz").groupBy("vertex_id").agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in XYZ))
    return total.select("vertex_id", *_unit_or_zero(_vec("s"), ("nx", "ny", "nz")))


def laplacians(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(vertex_id, lx, ly, lz): sum over neighbours q of (cot + cot) (q - p), the angles being those across the edge, over 4 times the vertex's area."""
    c = corners(vertices, faces)
    parts = []
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        angle = G.angle(at(i).minus(at(k)), at(j).minus(at(k)))
        cot = F.when(F.tan(angle) != 0, 1 / F.tan(angle)).otherwise(F.lit(0.0))
        for a, b in ((i, j), (j, i)):
            pull = at(b).minus(at(a)).times(cot)
            parts.append(F.struct(F.col(f"v{a}").alias("vertex_id"), *(x.alias(f"p{n}") for x, n in zip(pull, XYZ, strict=True)), (area() / 6).alias("area")))
    total = c.select(F.explode(F.array(*parts)).alias("e")).select("e.*").groupBy("vertex_id").agg(*(F.sum(f"p{n}").alias(f"p{n}") for n in XYZ), F.sum("area").alias("area"))
    return total.select("vertex_id", *(F.try_divide(F.col(f"p{n}"), 4 * F.col("area")).alias(f"l{n}") for n in XYZ))


def mean_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(vertex_id, curvature): minus the Laplacian's length along the normal; 0 without area."""
    both = laplacians(vertices, faces).join(vertex_normals(vertices, faces), "vertex_id")
    return both.select("vertex_id", F.coalesce(-(_vec("l").dot(_vec("n"))), F.lit(0.0)).alias("curvature"))


def inflate(vertices: DataFrame, faces: DataFrame, factor: float) -> DataFrame:
    """Vertices moved along their normals by factor times the mean length of their edges."""
    both = vertices.join(vertex_edge_lengths(vertices, faces), "vertex_id", "left").join(vertex_normals(vertices, faces), "vertex_id", "left")
    return both.select("vertex_id", *(F.coalesce(F.col(c) + factor * F.col("length") * F.col(f"n{c}"), F.col(c)).alias(c) for c in XYZ))


def add_noise(vertices: DataFrame, faces: DataFrame, factor: float, seed: int = 1) -> DataFrame:
    """Vertices moved by up to factor times the mean length of their edges along each axis; random numbers are hashes of the vertex, so a retried task makes the same."""
    from .sample import uniform

    both = vertices.join(vertex_edge_lengths(vertices, faces), "vertex_id", "left")
    return both.select("vertex_id", *(F.coalesce(F.col(c) + factor * F.col("length") * uniform("vertex_id", F.lit(c), seed=seed), F.col(c)).alias(c) for c in XYZ))


def sharpen(vertices: DataFrame, faces: DataFrame, factor: float = 1) -> DataFrame:
    """2 p - smooth(p), as many times as factor says."""
    for _ in range(math.ceil(factor)):
        soft = smooth(vertices, faces, 1).select("vertex_id", *(F.col(c).alias(f"s{c}") for c in XYZ))
        vertices = vertices.join(soft, "vertex_id").select("vertex_id", *((2 * F.col(c) - F.col(f"s{c}")).alias(c) for c in XYZ))
    return vertices


def centre_vertex(vertices: DataFrame, cx: F.Column, cy: F.Column, cz: F.Column) -> DataFrame:
    """The vertex closest to a point, ties to the smaller id."""
    d = G.point_point(V3.of("x", "y", "z"), V3.of(cx, cy, cz))
    return vertices.agg(F.min_by("vertex_id", F.struct(d, "vertex_id")).alias("vertex_id"))


def geodesic_pairs(vertices: DataFrame, faces: DataFrame, radius: float, rounds: int = 1_000) -> DataFrame:
    """(a, b, distance) for all vertices whose shortest path over edges is at most radius, a with itself at 0.

    Relaxed for all sources at once; a pair is only sent on while its path is within the radius."""
    e = edge_lengths(vertices, edges(faces).select("v0", "v1")).select("v0", "v1", "length")
    both = step(e.union(e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1"), "length")))
    known = vertices.select(F.col("vertex_id").alias("a"), F.col("vertex_id").alias("b"), F.lit(0.0).alias("distance"))
    front = known
    for _ in range(rounds):
        sent = front.join(both, F.col("b") == F.col("v0")).select("a", F.col("v1").alias("b"), (F.col("distance") + F.col("length")).alias("distance")).where(F.col("distance") <= radius)
        best = sent.groupBy("a", "b").agg(F.min("distance").alias("distance"))
        old = known.select("a", "b", F.col("distance").alias("old"))
        front = step(best.join(old, ["a", "b"], "left").where(F.col("old").isNull() | (F.col("distance") < F.col("old") - 1e-12)).drop("old"))
        if front.isEmpty():
            return known
        known = step(known.join(front.select("a", "b"), ["a", "b"], "left_anti").unionByName(front))
    raise RuntimeError(f"still relaxing after {rounds} rounds")


def difference_of_gaussians(props: DataFrame, column: str, pairs: DataFrame, sigma: float) -> DataFrame:
    """v - blur(v) over geodesic pairs(v0, v1, distance), unknown values left out."""
    from .props import blur

    soft = blur(props, column, pairs, sigma).select("vertex_id", F.col(column).alias("_soft"))
    return props.join(soft, "vertex_id", "left").withColumn(column, F.col(column) - F.col("_soft")).drop("_soft")


def strength(props: DataFrame, column: str, pairs: DataFrame, sigma: float) -> DataFrame:
    """v |v - blur(v)|."""
    dog = difference_of_gaussians(props, column, pairs, sigma).select("vertex_id", F.col(column).alias("_dog"))
    return props.join(dog, "vertex_id").withColumn(column, F.col(column) * F.abs("_dog")).drop("_dog")


def dilate(props: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """1 where a known value other than 0 is among the pairs(a, b), else 0; unknown values stay."""
    on = props.where(F.col(column).isNotNull() & (F.col(column) != 0)).select(F.col("vertex_id").alias("a"))
    near = pairs.join(on, "a", "left_semi").select(F.col("b").alias("vertex_id")).distinct().withColumn("_near", F.lit(1.0))
    return props.join(near, "vertex_id", "left").withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("_near", F.lit(0.0)))).drop("_near")


def erode(props: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """The complement of the complement dilated."""
    turned = lambda df: df.withColumn(column, F.when(F.col(column) == 0, 1.0).when(F.col(column).isNotNull(), 0.0))
    return turned(dilate(turned(props), column, pairs))


def keep_extrema(props: DataFrame, column: str, pairs: DataFrame, minima: bool = True, maxima: bool = True) -> DataFrame:
    """Values stay where no other known value among the pairs(a, b) is below (or none above); others become unknown. Ties stay."""
    value = props.select(F.col("vertex_id").alias("b"), F.col(column).alias("_v")).where("_v is not null")
    ends = pairs.join(value, "b").groupBy(F.col("a").alias("vertex_id")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    keep = F.lit(False)
    if minima:
        keep = keep | (F.col("_low") >= F.col(column))
    if maxima:
        keep = keep | (F.col("_high") <= F.col(column))
    return props.join(ends, "vertex_id", "left").withColumn(column, F.when(keep, F.col(column))).drop("_low", "_high")


def multiscale(props: DataFrame, column: str, pairs: DataFrame, sigmas: Sequence[float]) -> DataFrame:
    """One blurred copy for each sigma, named after it."""
    from .props import blur

    for n, sigma in enumerate(sigmas):
        soft = blur(props, column, pairs, sigma).select("vertex_id", F.col(column).alias(f"{column}_{n}"))
        props = props.join(soft, "vertex_id")
    return props


def furthest_vertices(vertices: DataFrame, faces: DataFrame, seeds: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """(place, vertex_id, distance): n times the vertex furthest (by paths over edges) from the seeds(node) and those chosen before, while it is at least `least` away.

    Ties go to the smaller id; n is a number of points, small beside the mesh."""
    e = edge_lengths(vertices, edges(faces).select("v0", "v1")).select("v0", "v1", "length")
    both = step(e.union(e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1"), "length")))
    found: list[tuple[int, int, float]] = []
    near = step(shortest_paths(both, seeds).select("node", "distance"))
    while len(found) < n:
        top = near.agg(F.max_by("node", F.struct("distance", -F.col("node"))).alias("node"), F.max("distance").alias("distance")).first()
        if top["node"] is None or top["distance"] <= 0 or top["distance"] < least:
            break
        found.append((len(found), top["node"], top["distance"]))
        one = vertices.where(F.col("vertex_id") == top["node"]).select(F.col("vertex_id").alias("node"))
        own = shortest_paths(both, one, top["distance"]).select("node", F.col("distance").alias("own"))
        near = step(near.join(own, "node", "left").select("node", F.least("distance", "own").alias("distance")))
    return vertices.sparkSession.createDataFrame(found, "place int, vertex_id long, distance double")


def vertex_means(vertices: DataFrame, faces: DataFrame, values: DataFrame, column: str = "value") -> DataFrame:
    """(vertex_id, column): means over a vertex's faces of the values (face_id, column), weighed by area.

    Vertices without faces, without values or with faces of no area only are left out. Partial sums meet by vertex, so a vertex of many faces is no task's burden."""
    own = corners(vertices, faces).select("face_id", area().alias("_area"), F.array("v0", "v1", "v2").alias("_v")).join(values.select("face_id", column).where(F.col(column).isNotNull()), "face_id")
    sums = own.select(F.explode("_v").alias("vertex_id"), "_area", (F.col("_area") * F.col(column)).alias("_sum")).groupBy("vertex_id").agg(F.sum("_sum").alias("_sum"), F.sum("_area").alias("_area"))
    return sums.where("_area > 0").select("vertex_id", (F.col("_sum") / F.col("_area")).alias(column))
