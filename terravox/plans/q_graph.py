"""Components, distance transforms and shortest paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Later, query
from .q_props import _GRAPH, graph
from .views import NX, NY, NZ, cells2, cells3, table

G = Later("operators.graph")

R2, R3 = (NX, NY), (NX, NY, NZ)

_ON2 = "on2 AS (SELECT ix, iy, CAST(iy AS BIGINT) * 50 + ix AS i FROM cells2 WHERE value > 45000)"
_REACH2 = f"""{_ON2}, e AS (SELECT a.i AS a, b.i AS b FROM on2 a JOIN on2 b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1),
  r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), comp AS (SELECT a AS i, min(b) AS component FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {_REACH2} SELECT 1 AS grid_id, ix, iy, component FROM on2 JOIN comp USING (i)", "cells2")
def grid_components2(spark, sf):
    return G.grid_components(cells2(spark, sf), 45000, R2)


_ON3 = "on3 AS (SELECT ix, iy, iz, (CAST(iz AS BIGINT) * 11 + iy) * 50 + ix AS i FROM cells3 WHERE value > 60000)"


@query(f"""WITH RECURSIVE {_ON3}, e AS (SELECT a.i AS a, b.i AS b FROM on3 a JOIN on3 b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) <= 1),
          r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT 1 AS grid_id, ix, iy, iz, component FROM on3 JOIN (SELECT a AS i, min(b) AS component FROM r GROUP BY 1) USING (i)""", "cells3")
def grid_components3(spark, sf):
    return G.grid_components(cells3(spark, sf), 60000, R3)


@query(f"WITH RECURSIVE {_REACH2} SELECT component, count(*) AS size FROM comp GROUP BY 1", "cells2")
def component_sizes(spark, sf):
    return G.component_sizes(G.grid_components(cells2(spark, sf), 45000, R2))


@query(f"""WITH RECURSIVE {_REACH2}, s AS (SELECT i, count(*) OVER (PARTITION BY component) AS size FROM comp)
          SELECT grid_id, ix, iy, CASE WHEN value IS NULL THEN NULL WHEN size IS NULL THEN 0.0::DOUBLE WHEN size < 3 THEN -5.0::DOUBLE ELSE value END AS value FROM cells2 LEFT JOIN s ON s.i = iy * 50 + ix""", "cells2")
def component_filter(spark, sf):
    c = cells2(spark, sf)
    return G.component_filter(c, G.grid_components(c, 45000, R2), 45000, 3, 0.0, -5.0).select("grid_id", "ix", "iy", "value")


@query(f"""WITH RECURSIVE {_REACH2}, b AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
          SELECT grid_id, ix, iy, CASE WHEN component IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM cells2 LEFT JOIN (SELECT i, component FROM comp JOIN b USING (component)) m ON m.i = iy * 50 + ix""", "cells2")
def largest_component(spark, sf):
    c = cells2(spark, sf)
    return G.largest_component(c, G.grid_components(c, 45000, R2)).select("grid_id", "ix", "iy", "value")


def _sources(c):
    """A sparse mask: cells far above the rest."""
    return c.withColumn("value", F.when(F.col("value") > 60000, F.col("value")).otherwise(F.lit(0.0)))


_MASK = "src AS (SELECT ix, iy, value FROM cells2 WHERE value > 60000), d AS (SELECT c.ix, c.iy, min(coalesce((c.ix - s.ix) * (c.ix - s.ix) + (c.iy - s.iy) * (c.iy - s.iy), 5202))::DOUBLE AS d2 FROM cells2 c LEFT JOIN src s ON true GROUP BY ALL)"


@query(f"WITH {_MASK} SELECT 1 AS grid_id, ix, iy, d2 FROM d", "cells2")
def distance_transform_sq(spark, sf):
    return G.squared_distance(_sources(cells2(spark, sf)), R2).drop("nearest")


def _signs(c):
    """Unknown, negative, zero and positive cells."""
    v = F.col("value")
    return c.withColumn("value", F.when(v > 60000, v).when(v < 10000, -v - 1).when(v.isNotNull(), F.lit(0.0)))


_SIGNS = """m AS (SELECT ix, iy, CASE WHEN value > 60000 THEN value WHEN value < 10000 THEN -value - 1 WHEN value IS NOT NULL THEN 0.0::DOUBLE END AS value FROM cells2)"""
_NEAR = "min(coalesce((c.ix - s.ix) * (c.ix - s.ix) + (c.iy - s.iy) * (c.iy - s.iy), {far}))::DOUBLE"


def _sources_sql(name: str, test: str, far: int = 5202) -> str:
    return f"{name} AS (SELECT c.ix, c.iy, {_NEAR.format(far=far)} AS d2 FROM m c LEFT JOIN (SELECT ix, iy FROM m WHERE {test}) s ON true GROUP BY ALL)"


@query(f"""WITH {_SIGNS}, {_sources_sql("o", "value <> 0")}, {_sources_sql("i", "value IS NULL OR value <= 0")}
          SELECT 1 AS grid_id, ix, iy, round(sqrt(o.d2) - sqrt(i.d2), 6) AS value FROM o JOIN i USING (ix, iy)""", "cells2")
def signed_distance(spark, sf):
    return G.signed_distance(_signs(cells2(spark, sf)), R2).withColumn("value", F.round("value", 6))


_SOLID = "m AS (SELECT ix, iy, iz, CASE WHEN value > 60000 THEN value WHEN value > 50000 THEN -value ELSE 0.0::DOUBLE END AS value FROM cells3)"


def _sources3_sql(name: str, test: str) -> str:
    near = "min(coalesce((c.ix - s.ix) * (c.ix - s.ix) + (c.iy - s.iy) * (c.iy - s.iy) + (c.iz - s.iz) * (c.iz - s.iz), 7803))::DOUBLE"
    return f"{name} AS (SELECT c.ix, c.iy, c.iz, {near} AS d2 FROM m c LEFT JOIN (SELECT ix, iy, iz FROM m WHERE {test}) s ON true GROUP BY ALL)"


@query(f"""WITH {_SOLID}, {_sources3_sql("o", "value <> 0")}, {_sources3_sql("i", "value <= 0")}
          SELECT 1 AS grid_id, ix, iy, iz, round(sqrt(o.d2) - sqrt(i.d2), 6) AS value FROM o JOIN i USING (ix, iy, iz)""", "cells3")
def signed_distance3(spark, sf):
    v = F.col("value")
    c = cells3(spark, sf).withColumn("value", F.when(v > 60000, v).when(v > 50000, -v).otherwise(0.0))
    return G.signed_distance(c, R3).withColumn("value", F.round("value", 6))


@query(f"""WITH {_SIGNS}, {_sources_sql("d", "value IS NULL OR value <> 0", 7803)} SELECT 1 AS grid_id, ix, iy, d2 FROM d""", "cells2")
def voronoi_distance(spark, sf):
    return G.voronoi(_signs(cells2(spark, sf)), R2).drop("value")


@query(f"""WITH {_SIGNS}, {_sources_sql("d", "value <> 0")}
          SELECT 1 AS grid_id, ix, iy, CASE WHEN m.value IS NULL THEN NULL WHEN d2 <= 2.25 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM d JOIN m USING (ix, iy)""", "cells2")
def dilate(spark, sf):
    return G.dilate(_signs(cells2(spark, sf)), 1.5, R2)


@query(f"""WITH {_SIGNS}, {_sources_sql("d", "value <= 1e-20")}
          SELECT 1 AS grid_id, ix, iy, CASE WHEN m.value IS NULL THEN NULL WHEN d2 > 1 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM d JOIN m USING (ix, iy)""", "cells2")
def erode(spark, sf):
    return G.erode(_signs(cells2(spark, sf)), 1.0, R2)


@query(f"""WITH RECURSIVE {_GRAPH}, w AS (SELECT v0, v1, 1.0::DOUBLE + (v0 + v1) % 5 AS length FROM graph),
          p(node, distance) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION SELECT v1, distance + length FROM p JOIN w ON v0 = node WHERE distance + length <= 6)
          SELECT node, min(distance) AS distance FROM p GROUP BY 1""")
def shortest_paths(spark, sf):
    edges = graph(spark, sf).withColumn("length", 1.0 + (F.col("v0") + F.col("v1")) % 5)
    return G.shortest_paths(edges, spark.range(1, 2).withColumnRenamed("id", "node"), 6.0).select("node", "distance")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_nationkey * 1000000 AS b FROM customer UNION ALL SELECT s_suppkey + 100000000, s_nationkey * 1000000 FROM supplier),
          h AS (SELECT b, min(a) AS a FROM e GROUP BY 1)
          SELECT e.a AS node, least(h.a, e.b) AS component FROM e JOIN h USING (b) WHERE least(h.a, e.b) < e.a
          UNION SELECT b, a FROM h WHERE a < b""")
def graph_components(spark, sf):
    """Customers and suppliers of a nation hang on the nation: the SQL says so in closed form."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_nationkey").cast("long") * 1000000).alias("b"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 100000000).alias("a"), (F.col("s_nationkey").cast("long") * 1000000).alias("b"))
    return G.components(c.union(s))
