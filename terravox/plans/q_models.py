"""Fits, clusters, meshes, samples and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Later, query
from .views import cells2, cells3, surfels

A = Later("operators.align")
C = Later("operators.cluster")
M = Later("operators.mesh")
R = Later("operators.render")
S = Later("operators.sample")
J = Later("operators.spatial_join")


def _mesh(spark, sf):
    """The raster as a surface, heights in tens of thousands."""
    return M.height_mesh(cells2(spark, sf).withColumn("value", F.col("value") / 10000), width=50)


_MESH = """v AS (SELECT iy * 50 + ix AS vertex_id, ix, iy, value / 10000 AS z FROM cells2 WHERE value IS NOT NULL),
  q AS (SELECT a.ix, a.iy, a.z AS z0, b.z AS z1, c.z AS z2, d.z AS z3, a.vertex_id AS va, b.vertex_id AS vb, c.vertex_id AS vc, d.vertex_id AS vd FROM v a JOIN v b ON b.ix = a.ix + 1 AND b.iy = a.iy JOIN v c ON c.ix = a.ix + 1 AND c.iy = a.iy + 1 JOIN v d ON d.ix = a.ix AND d.iy = a.iy + 1),
  t AS (SELECT va * 2 AS face_id, va AS v0, vb AS v1, vc AS v2, sqrt((z1 - z0) ^ 2 + (z2 - z1) ^ 2 + 1) / 2 AS area, ix + 2 / 3.0::DOUBLE AS cx, iy + 1 / 3.0::DOUBLE AS cy FROM q
        UNION ALL SELECT va * 2 + 1, va, vc, vd, sqrt((z3 - z0) ^ 2 + (z2 - z3) ^ 2 + 1) / 2, ix + 1 / 3.0::DOUBLE, iy + 2 / 3.0::DOUBLE FROM q)"""


@query(f"WITH {_MESH} SELECT round(sum(area), 6) AS area, round(sum(area * cx) / sum(area), 6) AS cx, round(sum(area * cy) / sum(area), 6) AS cy FROM t", "cells2")
def mesh_area(spark, sf):
    return M.measures(*_mesh(spark, sf), radius=False).select(*(F.round(c, 6).alias(c) for c in ("area", "cx", "cy")))


@query(f"WITH {_MESH} SELECT vertex_id, round(sum(area) / 3, 6) AS area FROM (SELECT unnest([v0, v1, v2]) AS vertex_id, area FROM t) GROUP BY 1", "cells2")
def vertex_area(spark, sf):
    return M.vertex_areas(*_mesh(spark, sf)).select("vertex_id", F.round("area", 6).alias("area"))


_EDGES = f"{_MESH}, e AS (SELECT v0, v1, count(*) AS faces FROM (SELECT least(a, b) AS v0, greatest(a, b) AS v1 FROM (SELECT v0 AS a, v1 AS b FROM t UNION ALL SELECT v1, v2 FROM t UNION ALL SELECT v2, v0 FROM t)) GROUP BY ALL)"


@query(f"WITH {_EDGES} SELECT v0, v1, faces FROM e", "cells2")
def mesh_edges(spark, sf):
    return M.edges(_mesh(spark, sf)[1]).select("v0", "v1", "faces")


@query(f"WITH {_EDGES} SELECT DISTINCT unnest([v0, v1]) AS vertex_id FROM e WHERE faces < 2", "cells2")
def mesh_boundary(spark, sf):
    return M.boundary_vertices(_mesh(spark, sf)[1])


@query(f"""WITH {_EDGES} SELECT v0, v1, round(sqrt((a.ix - b.ix) ^ 2 + (a.iy - b.iy) ^ 2 + (a.z - b.z) ^ 2), 6) AS length FROM e JOIN v a ON a.vertex_id = v0 JOIN v b ON b.vertex_id = v1""", "cells2")
def edge_lengths(spark, sf):
    v, f = _mesh(spark, sf)
    return M.edge_lengths(v, M.edges(f)).select("v0", "v1", F.round("length", 6).alias("length"))


@query(f"""WITH {_EDGES} SELECT count(*) * 4 AS faces, (SELECT count(DISTINCT vertex_id) FROM v) + (SELECT count(*) FROM e) AS vertices, round(sum(area), 5) AS area FROM t""", "cells2")
def subdivide(spark, sf):
    v, f = M.subdivide(*_mesh(spark, sf))
    n = v.agg(F.count("*").alias("vertices"))
    return M.corners(v, f).agg(F.count("*").alias("faces"), F.round(F.sum(M.area()), 5).alias("area")).crossJoin(F.broadcast(n)).select("faces", "vertices", "area")


def _smooth_sql(before: str, after: str) -> str:
    """A round of smoothing over places (vertex_id, x, y, z)."""
    return f"""l AS (SELECT v0, n.x, n.y, n.z, sqrt((n.x - p.x) ^ 2 + (n.y - p.y) ^ 2 + (n.z - p.z) ^ 2) AS length FROM b JOIN {before} p ON p.vertex_id = v0 JOIN {before} n ON n.vertex_id = v1),
  w AS (SELECT v0, x, y, z, avg(length) OVER (PARTITION BY v0) AS mean, CASE WHEN length > 0 THEN exp((length * length) / (-2 * (length / avg(length) OVER (PARTITION BY v0)) ^ 2)) ELSE 1 END AS w FROM l),
  {after} AS (SELECT p.vertex_id, (p.x + coalesce(sum(w * w.x), 0)) / (1 + coalesce(sum(w), 0)) AS x, (p.y + coalesce(sum(w * w.y), 0)) / (1 + coalesce(sum(w), 0)) AS y, (p.z + coalesce(sum(w * w.z), 0)) / (1 + coalesce(sum(w), 0)) AS z
       FROM {before} p LEFT JOIN w ON v0 = p.vertex_id GROUP BY p.vertex_id, p.x, p.y, p.z)"""


_FIRST = "b AS (SELECT v0, v1 FROM e UNION ALL SELECT v1, v0 FROM e), p0 AS (SELECT vertex_id, ix::DOUBLE AS x, iy::DOUBLE AS y, z FROM v)"


@query(f"""WITH {_EDGES}, {_FIRST}, {_smooth_sql("p0", "p1")}, s AS (WITH {_smooth_sql("p1", "p2")} SELECT * FROM p2)
          SELECT vertex_id, round(x + 1.23e-8, 6) AS x, round(y + 1.23e-8, 6) AS y, round(z + 1.23e-8, 6) AS z FROM s""", "cells2")
def mesh_smooth(spark, sf):
    return M.smooth(*_mesh(spark, sf), 2).select("vertex_id", *(F.round(F.col(c) + 1.23e-8, 6).alias(c) for c in "xyz"))


@query()
def closest_on_mesh(spark, sf):
    points = surfels(spark, sf).select("surfel_id", ((F.col("x") + 0.4) * 60).alias("x"), ((F.col("y") + 0.4) * 12).alias("y"), (F.col("z") * 10 + 3).alias("z"))
    return M.closest_on_mesh(points, *_mesh(spark, sf), 3.0)


@query()
def ray_hits(spark, sf):
    rays = surfels(spark, sf).select(F.col("surfel_id").alias("ray_id"), ((F.col("x") + 0.4) * 60).alias("x"), ((F.col("y") + 0.4) * 12).alias("y"), F.lit(1000.0).alias("z0"))
    return M.first_hits(rays, *_mesh(spark, sf), 1.0)


@query()
def surface_samples(spark, sf):
    return S.surface(*_mesh(spark, sf), 3.0)


@query()
def bernoulli_lod(spark, sf):
    return S.bernoulli(surfels(spark, sf), 0.3).select("surfel_id", "block_id")


@query("""WITH p AS (SELECT surfel_id, z, trunc((x + 0.4) * 20 + 0.5)::INTEGER AS ix, trunc((y + 0.4) * 20 + 0.5)::INTEGER AS iy FROM surfels)
          SELECT ix, iy, surfel_id, z, n FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY z DESC, surfel_id) AS r, count(*) OVER (PARTITION BY ix, iy) AS n FROM p WHERE ix BETWEEN 0 AND 15 AND iy BETWEEN 0 AND 15) WHERE r = 1""", "surfels")
def overhead_image(spark, sf):
    return R.overhead(surfels(spark, sf), 20, -0.4, -0.4, 16, 16).select("ix", "iy", "surfel_id", "z", "n")


@query("""WITH p AS (SELECT surfel_id, -(z - 1) AS depth, trunc(x * 100 / -(z - 1) + 40.5)::INTEGER AS ix, trunc(y * 100 / -(z - 1) + 30.5)::INTEGER AS iy FROM surfels)
          SELECT ix, iy, surfel_id, round(depth, 9) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY depth, surfel_id) AS r FROM p WHERE depth > 0 AND ix BETWEEN 0 AND 79 AND iy BETWEEN 0 AND 59) WHERE r = 1""", "surfels")
def zbuffer_image(spark, sf):
    points = surfels(spark, sf).withColumn("z", F.col("z") - 1)
    return R.pinhole(points, 100, 100, 40, 30, 80, 60).withColumn("depth", F.round("depth", 9)).select("ix", "iy", "surfel_id", "depth")


@query("""WITH c AS (SELECT ix, iy, CASE WHEN value > 45000 THEN 1 ELSE 0 END AS label FROM cells2)
          SELECT ix, iy, (coalesce(lead(label) OVER (PARTITION BY iy ORDER BY ix) <> label, false) OR coalesce(lead(label) OVER (PARTITION BY ix ORDER BY iy) <> label, false))::INTEGER AS boundary FROM c""", "cells2")
def label_boundary(spark, sf):
    c = cells2(spark, sf).select("ix", "iy", F.when(F.col("value") > 45000, 1).otherwise(0).alias("label"))
    return R.label_boundaries(c, "label").select("ix", "iy", "boundary")


@query("SELECT round(sum(ln(n // 10)), 6) AS score, count(*) AS labels FROM (SELECT object_id, count(*) AS n FROM surfels GROUP BY 1) WHERE n >= 10", "surfels")
def coverage_score(spark, sf):
    return R.coverage_score(surfels(spark, sf), "object_id", 10, 2).withColumn("score", F.round("score", 6))


@query("""WITH i AS (SELECT n_nationkey AS image_id, (n_nationkey % 5) / 5.0::DOUBLE AS ex, (n_nationkey % 3) / 3.0::DOUBLE AS ey, 1.0::DOUBLE AS ez, n_nationkey / 25.0::DOUBLE AS r FROM nation),
          d AS (SELECT surfel_id, r, (ex - x) * nx + (ey - y) * ny + (ez - z) * nz AS f, (ex - x) ^ 2 + (ey - y) ^ 2 + (ez - z) ^ 2 AS d2 FROM surfels, i)
          SELECT s.surfel_id, round(coalesce(sum(f / d2 * r) / sum(f / d2), 0.5), 6) AS r FROM surfels s LEFT JOIN d ON d.surfel_id = s.surfel_id AND f > 0 GROUP BY 1""", "surfels")
def weighted_color(spark, sf):
    from .views import table

    k = F.col("n_nationkey")
    images = table(spark, sf, "nation").select(k.alias("image_id"), ((k % 5) / 5.0).alias("ex"), ((k % 3) / 3.0).alias("ey"), F.lit(1.0).alias("ez"), (k / 25.0).alias("r"))
    return R.weighted_color(surfels(spark, sf), images, ["r"]).withColumn("r", F.round("r", 6))


@query("""SELECT object_id, count(*) AS n, round(avg(x), 9) AS cx, round(var_pop(x), 9) AS xx, round(covar_pop(x, y), 9) AS xy, round(covar_pop(y, z), 9) AS yz FROM surfels GROUP BY 1""", "surfels")
def object_moments(spark, sf):
    m = A.moments(surfels(spark, sf), key=("object_id",))
    return m.select("object_id", "n", *(F.round(c, 9).alias(c) for c in ("cx", "xx", "xy", "yz")))


_TURNS = ", ".join(f"({i}, {i} * pi() / 32)" for i in range(16))


@query(f"""WITH r(i, a) AS (VALUES {_TURNS}), b AS (SELECT object_id, i, (max(x * cos(a) + y * sin(a)) - min(x * cos(a) + y * sin(a))) * (max(y * cos(a) - x * sin(a)) - min(y * cos(a) - x * sin(a))) * (max(z) - min(z)) AS volume FROM surfels, r GROUP BY ALL)
          SELECT object_id, round(min(volume), 9) AS volume FROM b GROUP BY 1""", "surfels")
def oriented_box(spark, sf):
    return A.oriented_boxes(surfels(spark, sf)).select("object_id", F.round("volume", 9).alias("volume"))


@query()
def principal_axes(spark, sf):
    mean, axes, values = A.principal_axes(surfels(spark, sf))
    rows = [(i, *map(float, axes[i]), float(values[i])) for i in range(3)]
    return spark.createDataFrame(rows, "axis int, x double, y double, z double, variance double")


@query()
def fit_plane(spark, sf):
    n, d = A.fit_plane(surfels(spark, sf))
    return spark.createDataFrame([(*map(float, n), d)], "nx double, ny double, nz double, d double")


@query()
def ransac_plane(spark, sf):
    n, d, inliers = A.ransac_plane(surfels(spark, sf), 0.05)
    return spark.createDataFrame([(*map(float, n), d, inliers)], "nx double, ny double, nz double, d double, inliers long")


@query()
def icp(spark, sf):
    s = surfels(spark, sf).select("surfel_id", "x", "y", "z")
    import numpy as np

    turn = np.array([[0.9998, -0.02, 0, 0.01], [0.02, 0.9998, 0, -0.01], [0, 0, 1, 0.005], [0, 0, 0, 1]])
    m, error = A.icp(A.moved(s, turn), s, rounds=8)
    return spark.createDataFrame([(i, *map(float, m[i]), error) for i in range(4)], "row int, m0 double, m1 double, m2 double, m3 double, error double")


@query()
def kmeans_split(spark, sf):
    return C.kmeans(surfels(spark, sf), 8)


def _near(spark, sf):
    s = surfels(spark, sf)
    e = J.k_nearest(s, s, 9).where("query_id <> point_id").select(F.col("query_id").alias("a"), F.col("point_id").alias("b"), "distance")
    return s, e


@query()
def region_growing(spark, sf):
    s, e = _near(spark, sf)
    return C.region_growing(e.withColumn("affinity", C.affinity(F.col("distance"), None, 0.12)), 0.4)


@query()
def agglomerative_objects(spark, sf):
    s, e = _near(spark, sf)
    return C.agglomerate(s, e.select("a", "b"), 0.2, 0.3)


@query()
def segmentation_refine(spark, sf):
    s, e = _near(spark, sf)
    labels = s.select("surfel_id", F.col("object_id").alias("cluster"))
    return C.merge_small(C.refine(labels, e.select("a", "b")), 5)


@query()
def mean_shift(spark, sf):
    from .views import NX, NY, NZ

    return C.mean_shift(cells3(spark, sf), (NX, NY, NZ))
