"""Measures and predicates of shapes, evaluated over surfels, intervals and boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.interval import Interval
from ..functions.vec import V2, V3, LaterV3
from ..registry import query
from .views import surfels

P, N = LaterV3("x", "y", "z"), LaterV3("nx", "ny", "nz")
_C, _A = LaterV3(0.1, 0.0, -0.05), LaterV3(0.0, 0.6, 0.8)
LOW, HIGH = LaterV3(-0.1, -0.1, -0.1), LaterV3(0.1, 0.15, 0.05)


def _of(name: str, sql: str, *columns: tuple[str, Callable[[], F.Column]]) -> None:
    def run(spark, sf):
        return surfels(spark, sf).select("surfel_id", *(F.round(c(), 6).alias(n) for n, c in columns))

    query(f"SELECT surfel_id, {sql} FROM surfels", "surfels", name=name)(run)


def _test(name: str, sql: str, test: Callable[[], F.Column]) -> None:
    query(f"SELECT surfel_id FROM surfels WHERE {sql}", "surfels", name=name)(lambda spark, sf: surfels(spark, sf).where(test()).select("surfel_id"))


_CLAMP = "least(greatest(x, -0.1), 0.1) AS qx, least(greatest(y, -0.1), 0.15) AS qy, least(greatest(z, -0.1), 0.05) AS qz"
_of("distance_point_line", "round(sqrt(((y - 0) * 0.8 - (z + 0.05) * 0.6) ^ 2 + ((x - 0.1) * 0.8) ^ 2 + ((x - 0.1) * 0.6) ^ 2), 6) AS d", ("d", lambda: G.point_line(P, _C, _A)))
_of("distance_point_plane", "round(y * 0.6 + z * 0.8 + 0.02, 6) AS d", ("d", lambda: G.point_plane_signed(P, (_A, F.lit(0.02)))))
_of("distance_point_box", "round(sqrt((x - least(greatest(x, -0.1), 0.1)) ^ 2 + (y - least(greatest(y, -0.1), 0.15)) ^ 2 + (z - least(greatest(z, -0.1), 0.05)) ^ 2), 6) AS d", ("d", lambda: G.point_box(P, LOW, HIGH)))
_of("distance_point_sphere", "round(greatest(sqrt((x - 0.1) ^ 2 + y ^ 2 + (z + 0.05) ^ 2) - 0.1, 0), 6) AS d", ("d", lambda: G.point_sphere(P, _C, 0.1)))
_of("distance_point_ray", "round(CASE WHEN y * 0.6 + (z + 0.05) * 0.8 <= 0 THEN sqrt((x - 0.1) ^ 2 + y ^ 2 + (z + 0.05) ^ 2) ELSE sqrt((y * 0.8 - (z + 0.05) * 0.6) ^ 2 + ((x - 0.1) * 0.8) ^ 2 + ((x - 0.1) * 0.6) ^ 2) END, 6) AS d", ("d", lambda: G.point_ray(P, _C, _A)))
_of("distance_point_span", "round(sqrt((x + least(greatest((-x + 2 * y) / 5, 0), 1)) ^ 2 + (y - 2 * least(greatest((-x + 2 * y) / 5, 0), 1)) ^ 2 + z ^ 2), 6) AS d", ("d", lambda: G.point_span(P, V3.of(0, 0, 0), V3.of(-1, 2, 0))))
_of("closest_point_box", "round(least(greatest(x, -0.1), 0.1), 6) AS qx, round(least(greatest(y, -0.1), 0.15), 6) AS qy", ("qx", lambda: G.closest_in_box(P, LOW, HIGH).x), ("qy", lambda: G.closest_in_box(P, LOW, HIGH).y))
_of("furthest_point_box", "round(CASE WHEN x > 0 THEN -0.1 ELSE 0.1 END, 6)::DOUBLE AS qx, round(CASE WHEN y > 0.025 THEN -0.1 ELSE 0.15 END, 6)::DOUBLE AS qy", ("qx", lambda: G.furthest_in_box(P, LOW, HIGH).x), ("qy", lambda: G.furthest_in_box(P, LOW, HIGH).y))
_of("angle_between", "round(acos(greatest(-1, least(1, (x * nx + y * ny + z * nz) / (sqrt(x * x + y * y + z * z) * sqrt(nx * nx + ny * ny + nz * nz))))), 6) AS a", ("a", lambda: G.angle(P, N)))
_of("octant_code", "(x > 0)::INTEGER + 2 * (y > 0.025)::INTEGER + 4 * (z > -0.025)::INTEGER AS o", ("o", lambda: G.octant(P, LOW, HIGH)))
_of("triangle_measures", "round(sqrt((y * nz - z * ny) ^ 2 + (z * nx - x * nz) ^ 2 + (x * ny - y * nx) ^ 2) / 2, 6) AS area", ("area", lambda: G.triangle_area(V3.of(0, 0, 0), P, N)))
_of("affine_transform", "round(0.6 * x - 0.8 * y + 1, 6) AS tx, round(0.8 * x + 0.6 * y - 2, 6) AS ty", ("tx", lambda: G.affine(P, [0.6, -0.8, 0, 1, 0.8, 0.6, 0, -2, 0, 0, 1, 0, 0, 0, 0, 1]).x), ("ty", lambda: G.affine(P, [0.6, -0.8, 0, 1, 0.8, 0.6, 0, -2, 0, 0, 1, 0, 0, 0, 0, 1]).y))
_of("rotate_axis", "round(x * cos(0.3) - y * sin(0.3), 6) AS rx, round(x * sin(0.3) + y * cos(0.3), 6) AS ry", ("rx", lambda: G.rotate(P, V3.of(0, 0, 1), 0.3).x), ("ry", lambda: G.rotate(P, V3.of(0, 0, 1), 0.3).y))
_of("project_plane", "round(y - 0.6 * (y * 0.6 + z * 0.8 + 0.02), 6) AS py", ("py", lambda: G.project_to_plane(P, (_A, F.lit(0.02))).y))
_of("ray_plane_hit", "round(CASE WHEN abs(nz) > 1e-6 AND (0.5 - z) / nz >= 0 THEN (0.5 - z) / nz END, 4) AS t", ("t", lambda: F.round(G.ray_plane(P, N, (V3.of(0, 0, 1), F.lit(-0.5))), 4)))


@query("""SELECT surfel_id, round(CASE WHEN d >= 0.5 THEN 0 WHEN d <= 0.1 THEN pi() * 0.04 ELSE 0.09 * acos((d * d + 0.05) / (2 * d * 0.3)) + 0.04 * acos((d * d - 0.05) / (2 * d * 0.2)) - sqrt((0.5 - d) * (d + 0.1) * (d - 0.1) * (d + 0.5)) / 2 END, 6) AS area
          FROM (SELECT surfel_id, sqrt(x * x + y * y) AS d FROM surfels)""", "surfels")
def circle_overlap(spark, sf):
    return surfels(spark, sf).select("surfel_id", F.round(G.circle_overlap_area(V2.of(0, 0), 0.3, V2.of("x", "y"), 0.2), 6).alias("area"))


_test("boxes_intersect", "x <= 0.1 AND x + 0.05 >= -0.1 AND y <= 0.15 AND y + 0.05 >= -0.1 AND z <= 0.05 AND z + 0.05 >= -0.1", lambda: G.boxes_meet(P, P.plus(V3.of(0.05, 0.05, 0.05)), LOW, HIGH))
_test("spheres_intersect", "(x - 0.1) ^ 2 + y ^ 2 + (z + 0.05) ^ 2 <= 0.15::DOUBLE * 0.15::DOUBLE", lambda: G.spheres_meet(P, 0.1, _C, 0.05))
_test("plane_splits_box", "abs((y + 0.05) * 0.6 + (z + 0.05) * 0.8) < 0.07", lambda: G.plane_splits(P, P.plus(V3.of(0.1, 0.1, 0.1)), (_A, F.lit(0.0))))
_test("point_in_polygon", "abs(x) + abs(y) < 0.2", lambda: G.in_polygon2(V2.of("x", "y"), [(0.2, 0.0), (0.0, 0.2), (-0.2, 0.0), (0.0, -0.2)]))
_test("parallel_vectors", "abs(abs(nz / sqrt(nx * nx + ny * ny + nz * nz)) - 1) < 0.05", lambda: G.parallel(N.unit(), V3.of(0, 0, 1), 0.05))
_test("perpendicular_vectors", "abs(nz / sqrt(nx * nx + ny * ny + nz * nz)) < 0.05", lambda: G.perpendicular(N.unit(), V3.of(0, 0, 1), 0.05))



@query("""WITH i AS (SELECT surfel_id, least(x, nx) AS a, greatest(x, nx) AS b, least(y, ny) AS c, greatest(y, ny) AS d FROM surfels)
          SELECT surfel_id, round(least(a, c), 6) AS u0, round(greatest(b, d), 6) AS u1, round(greatest(a, c), 6) AS i0, round(least(b, d), 6) AS i1, a <= d + 1e-6 AND c <= b + 1e-6 AS meets,
                 round(least(a * c, a * d, b * c, b * d), 6) AS m0, round(greatest(a * c, a * d, b * c, b * d), 6) AS m1, round(a - d, 6) AS s0, round(CASE WHEN a <= 0 AND b >= 0 THEN 0 ELSE least(abs(a), abs(b)) END, 6) AS abs0 FROM i""", "surfels")
def interval_ops(spark, sf):
    _I, _J = Interval(F.least("x", "nx"), F.greatest("x", "nx")), Interval(F.least("y", "ny"), F.greatest("y", "ny"))
    u, i, m, s = _I.union(_J), _I.intersection(_J), _I.times(_J), _I.minus(_J)
    r = lambda c, n: F.round(c, 6).alias(n)
    return surfels(spark, sf).select("surfel_id", r(u.low, "u0"), r(u.high, "u1"), r(i.low, "i0"), r(i.high, "i1"), _I.meets(_J).alias("meets"), r(m.low, "m0"), r(m.high, "m1"), r(s.low, "s0"), r(_I.absolute().low, "abs0"))


@query("""WITH b AS (SELECT object_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM surfels GROUP BY 1)
          SELECT a.object_id AS a, b.object_id AS b, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0)), 6) AS shared,
                 round((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) * (greatest(a.z1, b.z1) - least(a.z0, b.z0)), 6) AS hull FROM b a JOIN b ON b.object_id = a.object_id + 1""", "surfels")
def box_union_intersect(spark, sf):
    s = surfels(spark, sf)
    box = s.groupBy("object_id").agg(*(f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, 0), (F.max, 1))))
    b = box.select((F.col("object_id") - 1).alias("object_id"), *(F.col(f"{c}{n}").alias(f"{c}{n}_") for c in "xyz" for n in (0, 1)))
    two = box.join(b, "object_id")
    corner = lambda n, s: V3.of(*(f"{c}{n}{s}" for c in "xyz"))
    boxes = (corner(0, ""), corner(1, ""), corner(0, "_"), corner(1, "_"))
    (il, ih), (ul, uh) = G.box_intersection(*boxes), G.box_union(*boxes)
    side = [F.greatest(F.lit(0.0), b - a) for a, b in zip(il, ih, strict=True)]
    return two.select(F.col("object_id").alias("a"), (F.col("object_id") + 1).alias("b"), F.round(side[0] * side[1] * side[2], 6).alias("shared"), F.round(G.box_volume(ul, uh), 6).alias("hull"))
