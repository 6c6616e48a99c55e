"""Constraint scans over surfels."""

from __future__ import annotations

from math import cos, pi

from pyspark.sql import functions as F

from ..registry import Later, query
from .views import assignments, cells2, surfels

P = Later("operators.predicates")

_IDS = "SELECT surfel_id FROM surfels WHERE "


def _scan(name: str, constraint, where: str) -> None:
    def run(spark, sf):
        points = surfels(spark, sf)
        c = constraint()
        return P.scan(points, c, P.block_stats(points) if c.block is not None else None).select("surfel_id")

    query(_IDS + where, "surfels", name=name)(run)


_A = 0.70710678
_scan("scan_box", lambda: P.box((-0.1, -0.1, -0.1), (0.1, 0.1, 0.1)), "x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1")
_scan("scan_obb", lambda: P.oriented_box((0.02, 0, 0), ((_A, _A, 0), (-_A, _A, 0), (0, 0, 1)), (0.15, 0.1, 0.2)),
      f"abs((x - 0.02) * {_A} + y * {_A}) <= 0.15 AND abs((x - 0.02) * -{_A} + y * {_A}) <= 0.1 AND abs(z) <= 0.2")
_scan("scan_sphere", lambda: P.sphere((0.05, 0, 0), 0.15), "(x - 0.05) * (x - 0.05) + y * y + z * z <= 0.15::DOUBLE * 0.15::DOUBLE")
_scan("scan_cylinder", lambda: P.cylinder((0, 0.05, 0), 0.12, -0.1, 0.2), "x * x + (y - 0.05) * (y - 0.05) <= 0.12::DOUBLE * 0.12::DOUBLE AND z BETWEEN -0.1 AND 0.2")
_scan("scan_halfspace", lambda: P.halfspace((0.6, 0.8, 0), -0.05), "x * 0.6 + y * 0.8 + z * 0 - 0.05 >= 0")
_scan("scan_line", lambda: P.near_line((0, 0, 0.1), (0, 1, 0), 0.08), "sqrt((z - 0.1) * (z - 0.1) + x * x) <= 0.08")
_scan("scan_plane", lambda: P.plane_side((0, 0, 1), 0.0, False, True, True, 0.05), "z > 0.05 OR abs(z) <= 0.05")
_scan("scan_plane_below", lambda: P.plane_side((0, 0, 1), 0.0, True, False, False, 0.05), "z < 0.05")
_scan("scan_coordinate", lambda: P.coordinate("y", -0.05, 0.05), "y BETWEEN -0.050001 AND 0.050001")
_scan("scan_normal", lambda: P.normal((0, 0, 1), pi / 2.2), f"nz >= {cos(pi / 2.2)!r}")
_scan("scan_timestamp", lambda: P.timestamp(20.0, 90.5), "timestamp BETWEEN 20 AND 90.5")
_scan("scan_timestamp_empty", lambda: P.timestamp(5.0, 1.0), "true")
_scan("scan_elevation", lambda: P.elevation(-0.02, 0.1), "elevation BETWEEN -0.020001 AND 0.100001")
_scan("scan_object", lambda: P.of_object(3), "object_id = 3")
_scan("scan_object_converse", lambda: P.of_object(3, True), "object_id IS DISTINCT FROM 3")
_scan("scan_source", lambda: P.source(True, False), "flags & 2 <> 0")
_scan("scan_boundary", lambda: P.boundary(False, True, True, False), "flags & 48 IN (48, 16)")
_scan("scan_mark", lambda: P.mark(True, False), "flags & 128 <> 0")
_scan("scan_multi", lambda: P.all_of([P.coordinate("x", -0.2, 0.2), P.of_object(2, True), P.timestamp(0, 200)]), "x BETWEEN -0.200001 AND 0.200001 AND object_id <> 2 AND timestamp BETWEEN 0 AND 200")
_scan("scan_view", lambda: P.in_view((0, 0, -1), (0, 0, 1), (0, 1, 0), 200, 100, 300.0, 300.0, 0.8, 1.2),
      """z + 1 > 0 AND z + 1 BETWEEN 0.8 AND 1.2 AND x * -300 / (z + 1) + 100 >= 0 AND x * -300 / (z + 1) + 100 < 200
         AND y * 300 / (z + 1) + 50 >= 0 AND y * 300 / (z + 1) + 50 < 100""")  # fmt: skip


@query("""WITH c AS (SELECT object_id, label FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY originator, confidence DESC, place) AS r FROM assignments WHERE originator <= 1) WHERE r = 1)
          SELECT s.surfel_id FROM surfels s JOIN c ON c.object_id = s.object_id WHERE c.label = '1-URGENT'""", "surfels", "assignments")
def scan_label(spark, sf):
    from ..operators.labels import current_label

    found = surfels(spark, sf).join(current_label(assignments(spark, sf)), "object_id", "left")
    return P.scan(found, P.of_label("1-URGENT")).select("surfel_id")


_UNDER = """u AS (SELECT s.surfel_id, sum(w * value) / sum(w) AS under FROM (
            SELECT surfel_id, CAST(floor(gx) AS INTEGER) + dx AS ix, CAST(floor(gy) AS INTEGER) + dy AS iy,
                   (CASE dx WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE dy WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) AS w
            FROM (SELECT surfel_id, (x + 0.4) * 60 AS gx, (y + 0.4) * 12 AS gy FROM surfels) g, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)) s
          JOIN cells2 c ON c.ix = s.ix AND c.iy = s.iy WHERE value IS NOT NULL AND w > 0 GROUP BY 1)"""


@query(f"WITH {_UNDER} SELECT surfel_id FROM u WHERE under - 30000 > 1e-6", "surfels", "cells2")
def scan_overhead_grid(spark, sf):
    return P.overhead_grid(surfels(spark, sf), cells2(spark, sf), "Less", F.lit(30000.0), None, 1e-6, (F.col("x") + 0.4) * 60, (F.col("y") + 0.4) * 12).select("surfel_id")


@query(f"WITH {_UNDER} SELECT surfel_id, round(under, 4) AS value FROM u", "surfels", "cells2")
def grid_sample_bilinear(spark, sf):
    from ..operators.grid import sample2

    got = sample2(surfels(spark, sf), cells2(spark, sf), (F.col("x") + 0.4) * 60, (F.col("y") + 0.4) * 12, "value")
    return got.where("value is not null").select("surfel_id", F.round("value", 4).alias("value"))


@query("""SELECT block_id, count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(timestamp) AS tmin, max(timestamp) AS tmax, min(surfel_id) AS min_id, max(surfel_id) AS max_id, bit_or(flags) AS flags,
            round(sqrt(count(*) / ((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) / least(max(x) - min(x), max(y) - min(y), max(z) - min(z)))), 6) AS resolution
          FROM surfels GROUP BY block_id""", "surfels")
def block_statistics(spark, sf):
    out = P.block_stats(surfels(spark, sf))
    return out.select("block_id", "n", "xmin", "xmax", "tmin", "tmax", "min_id", "max_id", "flags", F.round("resolution", 6).alias("resolution"))
