"""Chains of operations, as one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Later, query
from .views import NX, NY, NZ, cells2, cells3, props, surfels

P = Later("operators.predicates")
chains = Later("plans.chains")


@query("SELECT grid_id, ix, iy, round(CASE WHEN value / 1000 - 10 <= 30 THEN 0.0::DOUBLE ELSE sqrt(value / 1000 - 10) END, 6) AS value FROM cells2", "cells2")
def chain_grid2(spark, sf):
    words = "-divide 1000 -subtract 10 -threshold 30 0 keep -sqrt".split()
    return chains.GRID2.run(cells2(spark, sf), words, resolution=(NX, NY)).withColumn("value", F.round("value", 6))


@query("SELECT grid_id, ix, iy, round(abs(value - 20000) * 0.5, 4) AS value FROM cells3 WHERE iz = 3", "cells3")
def chain_grid3(spark, sf):
    out = chains.GRID3.run(cells3(spark, sf), "-subtract 20000 -abs -multiply 0.5 -slice z 3".split(), resolution=(NX, NY, NZ))
    return out.withColumn("value", F.round("value", 4))


@query("SELECT vertex_id, round(sqrt(size * 2), 6) AS extent, price FROM props", "props")
def chain_properties(spark, sf):
    words = ["-replace", "size", "Multiply", "2", "-replace", "size", "Sqrt", "", "-rename", "size", "extent", "-select", "extent,price"]
    return chains.PROPERTIES.run(props(spark, sf), words).withColumn("extent", F.round("extent", 6))


@query("SELECT surfel_id FROM surfels WHERE x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.2 AND 0.2 AND timestamp BETWEEN 0 AND 150 AND flags & 128 <> 0", "surfels")
def chain_constraint(spark, sf):
    c = chains.constraint("BoundingBox -0.2 -0.2 -0.2 0.2 0.2 0.2 Timestamp 0 150 Mark marked".split())
    points = surfels(spark, sf)
    return P.scan(points, c, P.block_stats(points)).select("surfel_id")
