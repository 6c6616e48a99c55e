"""Measures at edges and vertices, moved vertices, geodesic neighbourhoods and edits of the raster's surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Later, query
from .q_models import _EDGES, _FIRST, _mesh, _smooth_sql
from .views import NX

M = Later("operators.mesh")
N = Later("operators.mesh_more")
E = Later("operators.mesh_edit")

#: Places, faces with corners and normals, sides of faces, and edges with their faces and the vertices across.
_BASE = f"""{_EDGES}, p AS (SELECT vertex_id, ix::DOUBLE AS x, iy::DOUBLE AS y, z FROM v),
  fc AS (SELECT face_id, t.v0, t.v1, t.v2, a.x AS ax, a.y AS ay, a.z AS az, b.x AS wx, b.y AS wy, b.z AS wz, c.x AS cx, c.y AS cy, c.z AS cz,
                (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS ux, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS uy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS uz
         FROM t JOIN p a ON a.vertex_id = t.v0 JOIN p b ON b.vertex_id = t.v1 JOIN p c ON c.vertex_id = t.v2),
  fn AS (SELECT *, ux / sqrt(ux * ux + uy * uy + uz * uz) AS nx, uy / sqrt(ux * ux + uy * uy + uz * uz) AS ny, uz / sqrt(ux * ux + uy * uy + uz * uz) AS nz, sqrt(ux * ux + uy * uy + uz * uz) / 2 AS s FROM fc),
  h AS (SELECT face_id, v0 AS a, v1 AS b, v2 AS o FROM fc UNION ALL SELECT face_id, v1, v2, v0 FROM fc UNION ALL SELECT face_id, v2, v0, v1 FROM fc),
  ee AS (SELECT least(a, b) AS v0, greatest(a, b) AS v1, count(*) AS n, min(face_id) AS f0, max(face_id) AS f1, min_by(o, face_id) AS o0, max_by(o, face_id) AS o1 FROM h GROUP BY ALL),
  el AS (SELECT ee.*, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) AS length FROM ee JOIN p a ON a.vertex_id = v0 JOIN p b ON b.vertex_id = v1),
  vl AS (SELECT vertex_id, count(*) AS valence, avg(length) AS length FROM (SELECT v0 AS vertex_id, length FROM el UNION ALL SELECT v1, length FROM el) GROUP BY 1),
  vs AS (SELECT vertex_id, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz, sum(s) / 3 AS area FROM (SELECT unnest([v0, v1, v2]) AS vertex_id, nx, ny, nz, s FROM fn) GROUP BY 1),
  vn AS (SELECT vertex_id, area, sx / sqrt(sx * sx + sy * sy + sz * sz) AS nx, sy / sqrt(sx * sx + sy * sy + sz * sz) AS ny, sz / sqrt(sx * sx + sy * sy + sz * sz) AS nz FROM vs)"""


def _r(df, *columns: str, digits: int = 6):
    """Rounded a little off the halves, where sums in another order could fall to either side."""
    return df.select(*[c for c in df.columns if c not in columns], *(F.round(F.col(c) + 1.23e-8, digits).alias(c) for c in columns))


def _sql(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c} + 1.23e-8, {digits}) AS {c.rpartition('.')[2]}" for c in columns)


@query(f"WITH {_BASE} SELECT v0, v1, {_sql('dx', 'dy', 'dz')} FROM (SELECT v0, v1, (b.x - a.x) / length AS dx, (b.y - a.y) / length AS dy, (b.z - a.z) / length AS dz FROM el JOIN p a ON a.vertex_id = v0 JOIN p b ON b.vertex_id = v1)", "cells2")
def edge_directions(spark, sf):
    return _r(N.edge_directions(*_mesh(spark, sf)), "dx", "dy", "dz")


@query(f"""WITH {_BASE}, s AS (SELECT v0, v1, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM (SELECT least(a, b) AS v0, greatest(a, b) AS v1, nx, ny, nz FROM h JOIN fn USING (face_id)) GROUP BY ALL)
          SELECT v0, v1, {_sql('nx', 'ny', 'nz')} FROM (SELECT v0, v1, sx / l AS nx, sy / l AS ny, sz / l AS nz FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM s))""", "cells2")
def edge_normals(spark, sf):
    return _r(N.edge_normals(*_mesh(spark, sf)), "nx", "ny", "nz")


@query(f"""WITH {_BASE} SELECT v0, v1, round(CASE WHEN n < 2 THEN 0 ELSE sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) / length END + 1.23e-8, 6) AS aspect
          FROM el JOIN p a ON a.vertex_id = o0 JOIN p b ON b.vertex_id = o1""", "cells2")
def edge_aspects(spark, sf):
    return _r(N.edge_aspects(*_mesh(spark, sf)), "aspect")


_DIHEDRAL = """di AS (SELECT ee.v0, ee.v1, n, CASE WHEN n < 2 THEN 0 WHEN a.nx * ((b.ax + b.wx + b.cx) - (a.ax + a.wx + a.cx)) + a.ny * ((b.ay + b.wy + b.cy) - (a.ay + a.wy + a.cy)) + a.nz * ((b.az + b.wz + b.cz) - (a.az + a.wz + a.cz)) <= 0
                     THEN pi() - turn ELSE pi() + turn END AS angle
  FROM ee JOIN fn a ON a.face_id = f0 JOIN fn b ON b.face_id = f1, LATERAL (SELECT a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS c), LATERAL (SELECT CASE WHEN abs(c * c - 1) <= 1e-6 THEN 0 ELSE acos(c) END AS turn))"""


@query(f"WITH {_BASE}, {_DIHEDRAL} SELECT v0, v1, {_sql('angle')} FROM di", "cells2")
def dihedral(spark, sf):
    return _r(M.dihedral(*_mesh(spark, sf)), "angle")


@query(f"""WITH {_BASE}, c AS (SELECT face_id, s, unnest([v0, v1, v2]) AS vertex_id, unnest([ax, wx, cx]) AS x, unnest([ay, wy, cy]) AS y, unnest([az, wz, cz]) AS z, unnest([wx, cx, ax]) AS px, unnest([wy, cy, ay]) AS py, unnest([wz, cz, az]) AS pz,
                                     unnest([cx, ax, wx]) AS qx, unnest([cy, ay, wy]) AS qy, unnest([cz, az, wz]) AS qz FROM fn),
          g AS (SELECT vertex_id, sum(s) AS area, sum(acos(((px - x) * (qx - x) + (py - y) * (qy - y) + (pz - z) * (qz - z)) / sqrt(((px - x) ^ 2 + (py - y) ^ 2 + (pz - z) ^ 2) * ((qx - x) ^ 2 + (qy - y) ^ 2 + (qz - z) ^ 2)))) AS angle FROM c GROUP BY 1),
          rim AS (SELECT DISTINCT unnest([v0, v1]) AS vertex_id FROM ee WHERE n < 2)
          SELECT vertex_id, round(CASE WHEN vertex_id IN (SELECT vertex_id FROM rim) THEN 0 ELSE 3 * (2 * pi() - angle) / area END + 1.23e-8, 6) AS curvature FROM g""", "cells2")
def gauss_curvature(spark, sf):
    return _r(M.gauss_curvature(*_mesh(spark, sf)), "curvature")


@query(f"WITH {_BASE} SELECT vertex_id, valence, {_sql('length')} FROM vl", "cells2")
def vertex_edge_lengths(spark, sf):
    return _r(N.vertex_edge_lengths(*_mesh(spark, sf)), "length")


@query(f"WITH {_BASE}, {_DIHEDRAL} SELECT round((SELECT count(*) FROM ee) * 2.0::DOUBLE / (SELECT count(*) FROM p), 9) AS valence, round((SELECT avg(length) FROM el), 6) AS edge_length, round((SELECT avg(angle) FROM di), 6) AS edge_angle", "cells2")
def mesh_averages(spark, sf):
    v, f = _mesh(spark, sf)
    return N.averages(v, f, M.dihedral(v, f)).select(F.round("valence", 9).alias("valence"), F.round("edge_length", 6).alias("edge_length"), F.round("edge_angle", 6).alias("edge_angle"))


@query(f"WITH {_BASE} SELECT vertex_id, {_sql('nx', 'ny', 'nz')} FROM vn", "cells2")
def vertex_normals(spark, sf):
    return _r(N.vertex_normals(*_mesh(spark, sf)), "nx", "ny", "nz")


#: Cotangents at o of the side a-b, wy dot and cross product; pulls of neighbours on a vertex.
_LAPLACE = """ct AS (SELECT h.a, h.b, ((a.x - o.x) * (b.x - o.x) + (a.y - o.y) * (b.y - o.y) + (a.z - o.z) * (b.z - o.z)) / (2 * s) AS w FROM h JOIN fn USING (face_id) JOIN p a ON a.vertex_id = a JOIN p b ON b.vertex_id = h.b JOIN p o ON o.vertex_id = h.o),
  pull AS (SELECT i AS vertex_id, sum(w * (q.x - p.x)) AS x, sum(w * (q.y - p.y)) AS y, sum(w * (q.z - p.z)) AS z FROM (SELECT a AS i, b AS j, w FROM ct UNION ALL SELECT b, a, w FROM ct) JOIN p ON p.vertex_id = i JOIN p q ON q.vertex_id = j GROUP BY 1),
  lap AS (SELECT vertex_id, x / (4 * area) AS lx, y / (4 * area) AS ly, z / (4 * area) AS lz, -(x * nx + y * ny + z * nz) / (4 * area) AS curvature FROM pull JOIN vn USING (vertex_id))""".replace("a.vertex_id = a J", "a.vertex_id = h.a J")


@query(f"WITH {_BASE}, {_LAPLACE} SELECT vertex_id, {_sql('lx', 'ly', 'lz')} FROM lap", "cells2")
def vertex_laplacian(spark, sf):
    return _r(N.laplacians(*_mesh(spark, sf)), "lx", "ly", "lz")


@query(f"WITH {_BASE}, {_LAPLACE} SELECT vertex_id, {_sql('curvature')} FROM lap", "cells2")
def mean_curvature(spark, sf):
    return _r(N.mean_curvature(*_mesh(spark, sf)), "curvature")


@query(f"""WITH {_BASE}, m AS (SELECT vertex_id, coalesce(x + 0.3 * length * nx, x) AS x, coalesce(y + 0.3 * length * ny, y) AS y, coalesce(z + 0.3 * length * nz, z) AS z FROM p LEFT JOIN vl USING (vertex_id) LEFT JOIN vn USING (vertex_id))
          SELECT vertex_id, {_sql('x', 'y', 'z')} FROM m""", "cells2")
def mesh_inflate(spark, sf):
    return _r(N.inflate(*_mesh(spark, sf), 0.3), "x", "y", "z")


@query(f"""WITH {_EDGES}, {_FIRST}, {_smooth_sql("p0", "p1")} SELECT vertex_id, {_sql('x', 'y', 'z')} FROM (SELECT a.vertex_id, 2 * a.x - b.x AS x, 2 * a.y - b.y AS y, 2 * a.z - b.z AS z FROM p0 a JOIN p1 b USING (vertex_id))""", "cells2")
def mesh_sharpen(spark, sf):
    return _r(N.sharpen(*_mesh(spark, sf), 1), "x", "y", "z")


@query()
def mesh_noise(spark, sf):
    return N.add_noise(*_mesh(spark, sf), 0.1)


@query(f"WITH {_BASE}, c AS (SELECT sum(s * (ax + wx + cx)) / 3 / sum(s) AS x, sum(s * (ay + wy + cy)) / 3 / sum(s) AS y, sum(s * (az + wz + cz)) / 3 / sum(s) AS z FROM fn) SELECT p.vertex_id FROM p, c ORDER BY (p.x - c.x) ^ 2 + (p.y - c.y) ^ 2 + (p.z - c.z) ^ 2, vertex_id LIMIT 1", "cells2")
def centre_vertex(spark, sf):
    v, f = _mesh(spark, sf)
    c = M.measures(v, f, radius=False)
    near = v.crossJoin(F.broadcast(c.select("cx", "cy", "cz")))  # one row
    return N.centre_vertex(near, F.col("cx"), F.col("cy"), F.col("cz"))


#: Shortest paths over edges up to 4 from every vertex, and a property: heights above 5, unknown where the face count is odd.
_PATHS = """b2 AS (SELECT v0 AS a, v1 AS b, length FROM el UNION ALL SELECT v1, v0, length FROM el),
  w(a, b, distance) AS (SELECT vertex_id, vertex_id, 0.0::DOUBLE FROM p UNION SELECT w.a, b2.b, distance + length FROM w JOIN b2 ON b2.a = w.b WHERE distance + length <= 4),
  g AS (SELECT a, b, min(distance) AS distance FROM w GROUP BY ALL), pr AS (SELECT vertex_id, CASE WHEN ix % 5 = 0 THEN NULL ELSE z END AS u FROM v)"""
_WITH = f"WITH RECURSIVE {_BASE}, {_PATHS}"
_BLUR = "bl AS (SELECT a AS vertex_id, sum(exp(-distance * distance / 2) * u) / sum(exp(-distance * distance / 2)) AS soft FROM g JOIN pr ON pr.vertex_id = b WHERE u IS NOT NULL AND distance <= 3 GROUP BY 1)"


def _geodesic(spark, sf):
    v, f = _mesh(spark, sf)
    return N.geodesic_pairs(v, f, 4.0), v.select("vertex_id", F.when(F.col("x") % 5 != 0, F.col("z")).alias("u"))


def _spread(pairs):
    return pairs.select(F.col("a").alias("v0"), F.col("b").alias("v1"), "distance")


@query(f"{_WITH} SELECT a, b, {_sql('distance')} FROM g", "cells2")
def geodesic_pairs(spark, sf):
    return _r(_geodesic(spark, sf)[0], "distance")


@query(f"{_WITH}, {_BLUR} SELECT vertex_id, round(u - soft + 1.23e-8, 6) AS u FROM pr LEFT JOIN bl USING (vertex_id)", "cells2")
def prop_dog(spark, sf):
    pairs, props = _geodesic(spark, sf)
    return _r(N.difference_of_gaussians(props, "u", _spread(pairs), 1.0), "u")


@query(f"{_WITH}, {_BLUR} SELECT vertex_id, round(u * abs(u - soft) + 1.23e-8, 6) AS u FROM pr LEFT JOIN bl USING (vertex_id)", "cells2")
def prop_strength(spark, sf):
    pairs, props = _geodesic(spark, sf)
    return _r(N.strength(props, "u", _spread(pairs), 1.0), "u")


@query(f"""{_WITH}, {_BLUR}, b2l AS (SELECT a AS vertex_id, sum(exp(-distance * distance / 0.5) * u) / sum(exp(-distance * distance / 0.5)) AS soft FROM g JOIN pr ON pr.vertex_id = b WHERE u IS NOT NULL AND distance <= 1.5 GROUP BY 1)
          SELECT pr.vertex_id, u, round(CASE WHEN u IS NOT NULL THEN b2l.soft END + 1.23e-8, 6) AS u_0, round(CASE WHEN u IS NOT NULL THEN bl.soft END + 1.23e-8, 6) AS u_1 FROM pr LEFT JOIN bl USING (vertex_id) LEFT JOIN b2l USING (vertex_id)""", "cells2")
def prop_multiscale(spark, sf):
    pairs, props = _geodesic(spark, sf)
    return _r(N.multiscale(props, "u", _spread(pairs), (0.5, 1.0)), "u_0", "u_1")


_MASK = "mk AS (SELECT vertex_id, CASE WHEN u IS NULL THEN NULL WHEN u > 6.5 THEN 1.0::DOUBLE ELSE 0.0 END AS u FROM pr)"


def _masked(props):
    return props.withColumn("u", F.when(F.col("u") > 6.5, 1.0).when(F.col("u").isNotNull(), 0.0))


@query(f"{_WITH}, {_MASK} SELECT vertex_id, CASE WHEN u IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM g JOIN mk s ON s.vertex_id = g.a WHERE g.b = mk.vertex_id AND s.u <> 0) THEN 1.0::DOUBLE ELSE 0.0 END AS u FROM mk", "cells2")
def prop_dilate(spark, sf):
    pairs, props = _geodesic(spark, sf)
    return N.dilate(_masked(props), "u", pairs)


@query(f"{_WITH}, {_MASK} SELECT vertex_id, CASE WHEN u IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM g JOIN mk s ON s.vertex_id = g.a WHERE g.b = mk.vertex_id AND s.u = 0) THEN 0.0::DOUBLE ELSE 1.0 END AS u FROM mk", "cells2")
def prop_erode(spark, sf):
    pairs, props = _geodesic(spark, sf)
    return N.erode(_masked(props), "u", pairs)


@query(f"{_WITH}, x AS (SELECT a AS vertex_id, max(u) AS top FROM g JOIN pr ON pr.vertex_id = b GROUP BY 1) SELECT vertex_id, CASE WHEN u >= top THEN u END AS u FROM pr LEFT JOIN x USING (vertex_id)", "cells2")
def prop_keep_maxima(spark, sf):
    pairs, props = _geodesic(spark, sf)
    return N.keep_extrema(props, "u", pairs, minima=False)


# edits
_FACES = "SELECT face_id, v0, v1, v2 FROM"


@query("""SELECT face_id, v0, v1, v2 FROM (VALUES (0, 0, 1, 3), (1, 0, 3, 2), (2, 2, 3, 5), (3, 2, 5, 4), (4, 4, 5, 7), (5, 4, 7, 6), (6, 6, 7, 1), (7, 6, 1, 0), (8, 1, 7, 5), (9, 1, 5, 3), (10, 6, 0, 2), (11, 6, 2, 4)) t(face_id, v0, v1, v2)""")
def mesh_box(spark, sf):
    return E.box(spark, (0, 0, 0), (1, 2, 3))[1]


@query(f"WITH {_BASE} SELECT face_id, v0, v1, v2 FROM fc WHERE s0 <> s1 AND s1 <> s2 AND s2 <> s0".replace("FROM fc WHERE s0 <> s1 AND s1 <> s2 AND s2 <> s0", f"FROM (SELECT face_id, CASE WHEN v0 % {NX} = 3 THEN v0 + 1 ELSE v0 END AS v0, CASE WHEN v1 % {NX} = 3 THEN v1 + 1 ELSE v1 END AS v1, CASE WHEN v2 % {NX} = 3 THEN v2 + 1 ELSE v2 END AS v2 FROM fc) WHERE v0 <> v1 AND v1 <> v2 AND v2 <> v0"), "cells2")
def mesh_merge_vertices(spark, sf):
    """Vertices of one column of the raster become their neighbours."""
    v, f = _mesh(spark, sf)
    into = v.where(F.col("vertex_id") % NX == 3).select("vertex_id", (F.col("vertex_id") + 1).alias("into"))
    return E.merge_vertices(v, f, into)[1]


@query(f"""WITH {_BASE}, k AS (SELECT face_id FROM fc WHERE face_id % 6 = 0), n AS (SELECT *, row_number() OVER (ORDER BY face_id) - 1 AS r FROM fc JOIN k USING (face_id)), g AS (SELECT max(face_id) + 1 AS f, (SELECT max(vertex_id) + 1 FROM v) AS m FROM fc)
          SELECT face_id, v0, v1, v2 FROM fc WHERE face_id NOT IN (SELECT face_id FROM k) UNION ALL SELECT face_id, v0, v1, m + r FROM n, g UNION ALL SELECT f + 2 * r, v1, v2, m + r FROM n, g UNION ALL SELECT f + 2 * r + 1, v2, v0, m + r FROM n, g""", "cells2")
def mesh_split_faces(spark, sf):
    v, f = _mesh(spark, sf)
    return E.split_faces(v, f, f.where("face_id % 6 = 0"))[1]


@query(f"""WITH {_BASE}, sw AS (SELECT v0, v1, f0, f1, o0, o1 FROM ee WHERE n = 2 AND f1 = f0 + 1 AND f0 % 2 = 0)
          SELECT face_id, v0, v1, v2 FROM (
            SELECT f0 AS face_id, o0 AS v0, o1 AS v1, CASE WHEN h.a = sw.v0 THEN sw.v1 ELSE sw.v0 END AS v2 FROM sw JOIN h ON h.face_id = f0 AND h.o = o0
            UNION ALL SELECT f1, o1, o0, CASE WHEN h.a = sw.v0 THEN sw.v0 ELSE sw.v1 END FROM sw JOIN h ON h.face_id = f0 AND h.o = o0)
          UNION ALL SELECT face_id, v0, v1, v2 FROM fc WHERE face_id NOT IN (SELECT f0 FROM sw UNION ALL SELECT f1 FROM sw)""", "cells2")
def mesh_swap(spark, sf):
    """The other diagonal in every square."""
    v, f = _mesh(spark, sf)
    return E.swap(f, N.sides(v, f).where("faces = 2 and f1 = f0 + 1 and f0 % 2 = 0"))


@query(f"WITH {_BASE}, k AS (SELECT face_id FROM fc WHERE face_id % 7 = 0) SELECT face_id, v0, v1, v2 FROM fc WHERE face_id NOT IN (SELECT face_id FROM k) UNION ALL SELECT 1000000, 0, 1, 50", "cells2")
def mesh_create_delete_faces(spark, sf):
    f = _mesh(spark, sf)[1]
    return E.create_face(E.delete_faces(f, f.where("face_id % 7 = 0")), 1_000_000, 0, 1, NX)


@query(f"""WITH RECURSIVE {_BASE}, l AS (SELECT f0 AS a, f1 AS b FROM ee WHERE n = 2 UNION ALL SELECT f1, f0 FROM ee WHERE n = 2),
          r(a, b) AS (SELECT face_id, face_id FROM fc UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), k AS (SELECT a AS face_id, min(b) AS component FROM r GROUP BY 1)
          SELECT face_id, component FROM k""", "cells2")
def mesh_components(spark, sf):
    return M.face_components(_mesh(spark, sf)[1])


@query(f"""WITH RECURSIVE {_BASE}, l AS (SELECT f0 AS a, f1 AS b FROM ee WHERE n = 2 UNION ALL SELECT f1, f0 FROM ee WHERE n = 2),
          r(a, b) AS (SELECT face_id, face_id FROM fc UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), k AS (SELECT a AS face_id, min(b) AS component FROM r GROUP BY 1),
          big AS (SELECT component FROM k JOIN fn USING (face_id) GROUP BY 1 HAVING sum(s) >= 8) SELECT face_id, fc.v0, fc.v1, fc.v2 FROM fc JOIN k USING (face_id) JOIN big USING (component)""", "cells2")
def mesh_delete_small_components(spark, sf):
    return E.delete_small_components(*_mesh(spark, sf), 8.0)


@query(f"""WITH {_BASE} SELECT count(*) AS faces, (SELECT 2 * count(*) FROM p) AS vertices, round(2 * (SELECT sum(s) FROM fn), 5) AS area FROM (SELECT face_id FROM fc UNION ALL SELECT face_id FROM fc)""", "cells2")
def mesh_merge_list(spark, sf):
    v, f = _mesh(spark, sf)
    v, f = E.merge_meshes([(v, f), (v, f)])
    return M.corners(v, f).agg(F.count("*").alias("faces"), F.round(F.sum(M.area()), 5).alias("area")).crossJoin(v.agg(F.count("*").alias("vertices"))).select("faces", "vertices", "area")


def _counts(v, f):
    """What edits keep or bound: numbers, area and the longest and shortest edge."""
    e = M.edge_lengths(v, M.edges(f)).agg(F.count("*").alias("edges"), F.round(F.max("length"), 6).alias("longest"), F.round(F.min("length"), 6).alias("shortest"))
    one = M.corners(v, f).agg(F.count("*").alias("faces"), F.round(F.sum(M.area()), 6).alias("area"))
    return one.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(v.agg(F.count("*").alias("vertices"))))


@query()
def mesh_collapse_short_edges(spark, sf):
    return _counts(*E.collapse_short_edges(*_mesh(spark, sf), 1.05))


@query()
def mesh_subdivide_long_edges(spark, sf):
    return _counts(*E.subdivide_long_edges(*_mesh(spark, sf), 3.0))


@query()
def mesh_swap_edges(spark, sf):
    v, f = _mesh(spark, sf)
    return _counts(v, E.swap_edges(v, f, 0.05))


@query()
def mesh_fill_holes(spark, sf):
    v, f = _mesh(spark, sf)
    return _counts(v, E.fill_holes(v, f, 30.0))


@query()
def furthest_vertices(spark, sf):
    v, f = _mesh(spark, sf)
    seeds = v.agg(F.min("vertex_id").alias("node"))
    return N.furthest_vertices(v, f, seeds, 1)


@query(f"WITH {_BASE} SELECT vertex_id::BIGINT AS vertex_id, round(sum(s * value) / sum(s) + 1.23e-8, 6) AS value FROM (SELECT unnest([v0, v1, v2]) AS vertex_id, s, (face_id % 17)::DOUBLE AS value FROM fn WHERE face_id % 5 > 0) GROUP BY 1", "cells2")
def vertex_means(spark, sf):
    vertices, faces = _mesh(spark, sf)
    values = faces.where("face_id % 5 > 0").select("face_id", (F.col("face_id") % 17).cast("double").alias("value"))
    return _r(N.vertex_means(vertices, faces, values), "value")
