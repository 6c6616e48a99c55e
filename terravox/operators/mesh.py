"""Triangle meshes as tables: vertices (vertex_id, x, y, z) and faces (face_id, v0, v1, v2)."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vec import V3

CORNERS = ("v0", "v1", "v2")


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the positions of their corners: x0..z2. One shuffle of the corner table each way, however large the mesh."""
    flat = faces.select("*", F.posexplode(F.array(*CORNERS)).alias("_k", "_vertex"))
    place = vertices.select(F.col("vertex_id").alias("_vertex"), *(F.col(c).alias(f"_{c}") for c in "xyz"))
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(f"_{c}"))).alias(f"{c}{k}")
    return flat.join(place, "_vertex").groupBy(*faces.columns).agg(*(pick(k, c) for k in range(3) for c in "xyz"))


def at(k: int) -> V3:
    return V3.of(*(f"{c}{k}" for c in "xyz"))


def area() -> F.Column:
    return G.triangle_area(at(0), at(1), at(2))


def normal() -> V3:
    return at(1).minus(at(0)).cross(at(2).minus(at(0))).unit()


def measures(vertices: DataFrame, faces: DataFrame, radius: bool = True) -> DataFrame:
    """Area, area-weighted centroid and (if asked for, by a second pass) mean distance of face centroids from it."""
    c = corners(vertices, faces).withColumns({"area": area(), **{f"c{a}": sum((F.col(f"{a}{k}") for k in range(3)), F.lit(0.0)) / 3 for a in "xyz"}})
    whole = c.agg(F.sum("area").alias("total"), *((F.sum(F.col("area") * F.col(f"c{a}")) / F.sum("area")).alias(f"m{a}") for a in "xyz"))
    centre = whole.select(F.col("total").alias("area"), F.col("mx").alias("cx"), F.col("my").alias("cy"), F.col("mz").alias("cz"))
    if not radius:
        return centre
    d = F.sqrt(sum(((F.col(f"c{a}") - F.col(f"m{a}")) * (F.col(f"c{a}") - F.col(f"m{a}")) for a in "xyz"), F.lit(0.0)))
    out = c.crossJoin(F.broadcast(whole)).agg((F.sum(F.col("area") * d) / F.sum("area")).alias("radius"))
    # each side is one row, of nulls for a mesh without faces
    return centre.crossJoin(F.broadcast(out))


def edges(faces: DataFrame) -> DataFrame:
    """(v0, v1, faces, f0, f1) once an edge, v0 < v1."""
    sides = F.explode(F.array(*(F.struct(F.least(a, b).alias("v0"), F.greatest(a, b).alias("v1")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    return faces.select("face_id", sides.alias("e")).groupBy("e.v0", "e.v1").agg(F.count("*").alias("faces"), F.min("face_id").alias("f0"), F.max("face_id").alias("f1"))


def edge_lengths(vertices: DataFrame, e: DataFrame) -> DataFrame:
    a, b = (vertices.select(F.col("vertex_id").alias(v), *(F.col(c).alias(f"{v}{c}") for c in "xyz")) for v in ("v0", "v1"))
    return e.join(a, "v0").join(b, "v1").select(*e.columns, G.point_point(V3.of(*(f"v0{c}" for c in "xyz")), V3.of(*(f"v1{c}" for c in "xyz"))).alias("length"))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return edges(faces).where("faces < 2").select(F.explode(F.array("v0", "v1")).alias("vertex_id")).distinct()


def vertex_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """A third of the faces around."""
    c = corners(vertices, faces).select(area().alias("area"), F.explode(F.array(*CORNERS)).alias("vertex_id"))
    return c.groupBy("vertex_id").agg((F.sum("area") / 3).alias("area"))


def gauss_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """3 (2 pi - angles) / area of the faces around; 0 on the boundary."""
    p = [at(k) for k in range(3)]
    angles = [G.angle(p[(k + 1) % 3].minus(p[k]), p[(k + 2) % 3].minus(p[k])) for k in range(3)]
    c = corners(vertices, faces).select(area().alias("area"), F.explode(F.array(*(F.struct(F.col(v).alias("vertex_id"), a.alias("angle")) for v, a in zip(CORNERS, angles, strict=True)))).alias("e"))
    inner = c.groupBy("e.vertex_id").agg(F.sum("area").alias("area"), F.sum("e.angle").alias("angle"))
    rim = boundary_vertices(faces).withColumn("rim", F.lit(True))
    value = F.coalesce(F.try_divide(3 * (2 * F.pi() - F.col("angle")), F.col("area")), F.lit(0.0))
    return inner.join(rim, "vertex_id", "left").select("vertex_id", F.when(F.col("rim"), 0.0).otherwise(value).alias("curvature"))


def dihedral(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v0, v1, angle): pi -/+ the angle between the two faces' normals, convex edges below pi; 0 on the boundary."""
    c = corners(vertices, faces)
    n = normal()
    third = c.select("face_id", *n.named("nx", "ny", "nz"), *(F.col(v) for v in CORNERS), *(((F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3).alias(f"c{a}") for a in "xyz"))
    e = edges(faces)
    a = third.select(F.col("face_id").alias("f0"), *(F.col(k).alias(f"a{k}") for k in ("nx", "ny", "nz", "cx", "cy", "cz")))
    b = third.select(F.col("face_id").alias("f1"), *(F.col(k).alias(f"b{k}") for k in ("nx", "ny", "nz", "cx", "cy", "cz")))
    both = e.join(a, "f0").join(b, "f1")
    na, nb = V3.of("anx", "any", "anz"), V3.of("bnx", "bny", "bnz")
    across = V3.of("bcx", "bcy", "bcz").minus(V3.of("acx", "acy", "acz"))
    turn = F.when(F.abs(na.dot(nb) * na.dot(nb) - 1) <= 1e-6, F.lit(0.0)).otherwise(F.acos(G.clamp(na.dot(nb), -1, 1)))
    angle = F.when(na.dot(across) <= 0, F.pi() - turn).otherwise(F.pi() + turn)
    return both.select("v0", "v1", F.when(F.col("faces") < 2, 0.0).otherwise(angle).alias("angle"))


def subdivide(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each face becomes four. A midpoint's id is made of its edge, so both faces agree without a numbering pass."""
    middle = lambda a, b: F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    name = lambda v: F.col(v).cast("string")
    m = {k: middle(a, b) for k, (a, b) in {"m01": ("v0", "v1"), "m12": ("v1", "v2"), "m20": ("v2", "v0")}.items()}
    small = F.posexplode(F.array(*(F.struct(a.alias("v0"), b.alias("v1"), c.alias("v2")) for a, b, c in ((name("v0"), m["m01"], m["m20"]), (name("v1"), m["m12"], m["m01"]), (name("v2"), m["m20"], m["m12"]), (m["m01"], m["m12"], m["m20"])))))
    new_faces = faces.select("face_id", small.alias("k", "t")).select((F.col("face_id") * 4 + F.col("k")).alias("face_id"), "t.v0", "t.v1", "t.v2")
    e = edges(faces)
    a, b = (vertices.select(F.col("vertex_id").alias(v), *(F.col(c).alias(f"{v}{c}") for c in "xyz")) for v in ("v0", "v1"))
    mids = e.join(a, "v0").join(b, "v1").select(middle("v0", "v1").alias("vertex_id"), *(((F.col(f"v0{c}") + F.col(f"v1{c}")) / 2).alias(c) for c in "xyz"))
    return vertices.select(name("vertex_id").alias("vertex_id"), "x", "y", "z").union(mids), new_faces


def flip(faces: DataFrame) -> DataFrame:
    return faces.select("face_id", F.col("v0"), F.col("v2").alias("v1"), F.col("v1").alias("v2"))


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.join(faces.select(F.explode(F.array(*CORNERS)).alias("vertex_id")), "vertex_id", "left_semi")


def delete_vertex(vertices: DataFrame, faces: DataFrame, vertex) -> tuple[DataFrame, DataFrame]:
    """A vertex and the faces that have it."""
    return vertices.where(F.col("vertex_id") != vertex), faces.where(~F.array_contains(F.array(*CORNERS), F.lit(vertex)))


def face_components(faces: DataFrame) -> DataFrame:
    """(face_id, component): faces joined by shared edges."""
    from .graph import components

    joined = components(edges(faces).where("f0 <> f1").select(F.col("f0").alias("a"), F.col("f1").alias("b")))
    return faces.join(joined, F.col("face_id") == F.col("node"), "left").select("face_id", F.coalesce("component", "face_id").alias("component"))


def smooth(vertices: DataFrame, faces: DataFrame, factor: float = 1) -> DataFrame:
    """(p + sum w q) / (1 + sum w) over the vertices around, as many times as factor says (a fraction counts as one more).

    w = exp(-length^2 / (2 sigma^2)) with sigma = length / mean length of the edges at the vertex, and 1 for an edge
    without length. All lengths are those before the round. A vertex whose edges have no length, or that has none, stays."""
    e = edges(faces).select("v0", "v1")
    both = e.union(e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1")))
    for _ in range(math.ceil(factor)):
        here, there = (vertices.select(F.col("vertex_id").alias(v), *(F.col(c).alias(f"{v}{c}") for c in "xyz")) for v in ("v0", "v1"))
        met = both.join(here, "v0").join(there, "v1")
        met = met.withColumn("length", G.point_point(V3.of(*(f"v0{c}" for c in "xyz")), V3.of(*(f"v1{c}" for c in "xyz"))))
        # with that sigma the exponent is -(mean length)^2 / 2, whatever the edge
        flat = lambda c: F.sum(F.when(F.col("length") > 0, 0).otherwise(1) * F.col(c))
        long = lambda c: F.sum(F.when(F.col("length") > 0, 1).otherwise(0) * F.col(c))
        one = met.withColumn("one", F.lit(1.0))
        sums = one.groupBy(F.col("v0").alias("vertex_id")).agg(F.avg("length").alias("mean"), *(f(c).alias(n) for c in ("one", "v1x", "v1y", "v1z") for f, n in ((flat, f"flat_{c}"), (long, f"long_{c}"))))
        w = F.exp(F.col("mean") * F.col("mean") / -2)
        total = lambda c: F.col(f"flat_{c}") + w * F.col(f"long_{c}")
        moved = lambda c: F.when(F.col("mean") > 0, (F.col(c) + total(f"v1{c}")) / (1 + total("one"))).otherwise(F.col(c)).alias(c)
        vertices = vertices.join(sums, "vertex_id", "left").select("vertex_id", *(moved(c) for c in "xyz"))
    return vertices


def closest_on_mesh(points: DataFrame, vertices: DataFrame, faces: DataFrame, most: float, ident: str = "surfel_id") -> DataFrame:
    """(id, face_id, distance) of the closest face within `most`: faces are dealt to every cube that their extent, grown by `most`, touches.

    The distance is built in steps of their own, so no expression is repeated inside another: normals once a face, then
    the plane's distance where the foot lies inside the face, and the least distance to the sides elsewhere."""
    c = corners(vertices, faces).withColumn("n", F.array(*normal()))
    size = 2 * most
    dealt = c
    for a in "xyz":
        lo, hi = F.least(*(F.col(f"{a}{k}") for k in range(3))) - most, F.greatest(*(F.col(f"{a}{k}") for k in range(3))) + most
        dealt = dealt.withColumn(f"c{a}", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))
    p = points.select(ident, "x", "y", "z", *(F.floor(F.col(a) / size).alias(f"c{a}") for a in "xyz"))
    met = p.join(dealt, ["cx", "cy", "cz"])
    here, n = V3.of("x", "y", "z"), V3(F.col("n")[0], F.col("n")[1], F.col("n")[2])
    met = met.withColumn("h", here.minus(at(0)).dot(n))
    sides = ((0, 1), (1, 2), (2, 0))
    # the foot and the point lie on the same side of a side's plane, as that plane holds the normal
    met = met.withColumns({f"in{i}": at(j).minus(at(i)).cross(here.minus(at(i))).dot(n) >= 0 for i, j in sides})
    met = met.withColumns({f"t{i}": G.clamp(F.coalesce(F.try_divide(here.minus(at(i)).dot(at(j).minus(at(i))), at(j).minus(at(i)).squared()), F.lit(0.0)), 0, 1) for i, j in sides})
    met = met.withColumns({f"d{i}": here.minus(at(i)).minus(at(j).minus(at(i)).times(F.col(f"t{i}"))).norm() for i, j in sides})
    flat = n.squared() > 0
    d = F.when(flat & F.col("in0") & F.col("in1") & F.col("in2"), F.abs("h")).otherwise(F.least("d0", "d1", "d2"))
    near = met.select(ident, "face_id", d.alias("distance")).where(F.col("distance") <= most)
    return near.groupBy(ident).agg(F.min_by("face_id", F.struct("distance", "face_id")).alias("face_id"), F.min("distance").alias("distance"))


def first_hits(rays: DataFrame, vertices: DataFrame, faces: DataFrame, cell: float) -> DataFrame:
    """(ray_id, face_id, t) of the first face that each ray meets; rays: ray_id, x, y (vertical rays downwards from z0).

    Overhead rays: faces are dealt to the ground cells that their extent touches, so a ray meets only faces above its cell."""
    c = corners(vertices, faces)
    dealt = c
    for a in "xy":
        ends = [F.floor(f(*(F.col(f"{a}{k}") for k in range(3))) / cell) for f in (F.least, F.greatest)]
        dealt = dealt.withColumn(f"c{a}", F.explode(F.sequence(*ends)))
    r = rays.select("ray_id", "x", "y", F.col("z0").alias("top"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    t = G.ray_triangle(V3.of("x", "y", "top"), V3.of(0, 0, -1), at(0), at(1), at(2))
    met = r.join(dealt, ["cx", "cy"]).select("ray_id", "face_id", t.alias("t")).where("t is not null")
    return met.groupBy("ray_id").agg(F.min_by("face_id", F.struct("t", "face_id")).alias("face_id"), F.min("t").alias("t"))


def height_mesh(cells: DataFrame, most_jump: float = float("inf"), width: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """A raster as a surface: two triangles for each square of four known cells, none across a jump."""
    known = cells.where("value is not null").select(F.col("ix").cast("long"), F.col("iy").cast("long"), "value")
    vid = lambda x, y: (y * width + x)
    v = known.select(vid(F.col("ix"), F.col("iy")).alias("vertex_id"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.col("value").alias("z"))
    q = known
    for n, (dx, dy) in enumerate(list(product((0, 1), repeat=2))[1:], 1):
        q = q.join(known.select((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.col("value").alias(f"h{n}")), ["ix", "iy"])
    jump = F.greatest("value", "h1", "h2", "h3") - F.least("value", "h1", "h2", "h3")
    a, b, c, d = (vid(F.col("ix") + dx, F.col("iy") + dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)))
    two = F.posexplode(F.array(F.struct(a.alias("v0"), b.alias("v1"), c.alias("v2")), F.struct(a.alias("v0"), c.alias("v1"), d.alias("v2"))))
    f = q.where(jump <= most_jump).select(a.alias("base"), two.alias("k", "t")).select((F.col("base") * 2 + F.col("k")).alias("face_id"), "t.v0", "t.v1", "t.v2")
    return v, f
