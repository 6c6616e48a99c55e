"""Distance joins over surfels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Later, query
from .views import surfels, table

S = Later("operators.sets")
J = Later("operators.spatial_join")

_D2 = "(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)"


def _knn_sql(k: int, where: str = "true", more: str = "") -> str:
    return f"""WITH d AS (SELECT q.surfel_id AS query_id, p.surfel_id AS point_id, sqrt({_D2}) AS distance FROM surfels q JOIN surfels p ON {where}),
          r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS INTEGER) AS rank FROM d)
          SELECT query_id, point_id, round(distance, 9) AS distance, rank FROM r WHERE rank <= {k}{more}"""


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 9)).select("query_id", "point_id", "distance", *[c for c in df.columns if c == "rank"])


@query(_knn_sql(16), "surfels")
def knn_self(spark, sf):
    s = surfels(spark, sf)
    return _rounded(J.k_nearest(s, s, 16))


@query(_knn_sql(3, "q.object_id < 5 AND p.object_id >= 5"), "surfels")
def knn_cross(spark, sf):
    s = surfels(spark, sf)
    return _rounded(J.k_nearest(s.where("object_id < 5"), s.where("object_id >= 5"), 3))


@query(_knn_sql(4, f"sqrt({_D2}) >= 0.05"), "surfels")
def knn_min_distance(spark, sf):
    s = surfels(spark, sf)
    return _rounded(J.k_nearest(s, s, 4, least=0.05))


@query(_knn_sql(1, "q.object_id <> p.object_id", "").replace(", rank FROM r", " FROM r"), "surfels")
def closest_compatible(spark, sf):
    s = surfels(spark, sf)
    return _rounded(J.closest(s, s, carry=("object_id",), residual=F.col("qobject_id") != F.col("pobject_id")))


@query(f"SELECT q.surfel_id AS query_id, p.surfel_id AS point_id, round(sqrt({_D2}), 9) AS distance FROM surfels q JOIN surfels p ON {_D2} <= 0.08::DOUBLE * 0.08::DOUBLE", "surfels")
def range_join(spark, sf):
    s = surfels(spark, sf)
    return _rounded(J.range_pairs(s, s, 0.08))


@query(f"SELECT q.surfel_id FROM surfels q WHERE EXISTS (SELECT 1 FROM surfels p WHERE p.surfel_id <> q.surfel_id AND {_D2} <= 0.05::DOUBLE * 0.05::DOUBLE)", "surfels")
def range_semi_any(spark, sf):
    s = surfels(spark, sf)
    return J.any_within(s, s, 0.05).select("surfel_id")


@query(f"""SELECT query_id, point_id, round(distance, 9) AS distance FROM (SELECT q.surfel_id AS query_id, p.surfel_id AS point_id, sqrt({_D2}) AS distance, row_number() OVER (PARTITION BY q.surfel_id ORDER BY sqrt({_D2}) DESC, p.surfel_id) AS r
          FROM surfels q, surfels p) WHERE r = 1""", "surfels")
def furthest(spark, sf):
    s = surfels(spark, sf)
    return J.furthest(s, s).withColumn("distance", F.round("distance", 9))


@query(f"""WITH n AS (SELECT DISTINCT p.object_id AS object0, q.object_id AS object1, q.surfel_id FROM surfels q JOIN surfels p ON q.object_id <> p.object_id AND {_D2} <= 0.08::DOUBLE * 0.08::DOUBLE)
          SELECT object0, object1, round(count(*) / s.n::DOUBLE, 9) AS overlap FROM n JOIN (SELECT object_id, count(*) AS n FROM surfels GROUP BY 1) s ON s.object_id = object1 GROUP BY object0, object1, s.n HAVING count(*) / s.n::DOUBLE > 0.05""", "surfels")
def overlap_relationship(spark, sf):
    return J.overlaps(surfels(spark, sf), 0.08, 0.05).withColumn("overlap", F.round("overlap", 9))


@query("SELECT surfel_id, min(surfel_id) OVER (PARTITION BY rx, ry, rz) AS representative FROM (SELECT surfel_id, round(x * 4) AS rx, round(y * 4) AS ry, round(z * 4) AS rz FROM surfels)", "surfels")
def coincident_weld(spark, sf):
    snapped = surfels(spark, sf).select("surfel_id", *(F.round(F.col(a) * 4).alias(a) for a in "xyz"))
    return J.weld(snapped)


@query("""WITH i AS (SELECT c_custkey AS image_id, c_acctbal / 10000.0::DOUBLE AS ex, (c_custkey % 7) / 10.0::DOUBLE - 0.3 AS ey, -1.0::DOUBLE AS ez FROM customer),
          s AS (SELECT surfel_id, image_id, (z + 1) / sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey) + (z + 1) * (z + 1)) AS c, (x - ex) * (x - ex) + (y - ey) * (y - ey) + (z + 1) * (z + 1) AS d2 FROM surfels, i WHERE z + 1 > 0)
          SELECT surfel_id, image_id, round(c / d2, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY surfel_id ORDER BY c / d2 DESC, image_id) AS r FROM s WHERE c >= 0.9) WHERE r = 1""", "surfels")
def best_view_image(spark, sf):
    images = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("image_id"), (F.col("c_acctbal") / 10000.0).alias("ex"), ((F.col("c_custkey") % 7) / 10.0 - 0.3).alias("ey"), F.lit(-1.0).alias("ez"),
        F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(1.0).alias("tz"), F.lit(0.9).alias("cos_half_angle"),
    )
    return J.best_view(surfels(spark, sf), images).withColumn("score", F.round("score", 9))


@query(f"""WITH d AS (SELECT q.surfel_id AS query_id, p.x, p.y, p.z, row_number() OVER (PARTITION BY q.surfel_id ORDER BY sqrt({_D2}), p.surfel_id) AS r FROM surfels q, surfels p)
          SELECT query_id, round(covar_pop(x, x), 9) AS xx, round(covar_pop(x, y), 9) AS xy, round(covar_pop(y, z), 9) AS yz FROM d WHERE r <= 8 GROUP BY 1""", "surfels")
def knn_normal_covariance(spark, sf):
    s = surfels(spark, sf)
    near = J.k_nearest(s, s, 8).join(s.select(F.col("surfel_id").alias("point_id"), "x", "y", "z"), "point_id")
    c = lambda a, b: F.round(F.covar_pop(a, b), 9)
    return near.groupBy("query_id").agg(c("x", "x").alias("xx"), c("x", "y").alias("xy"), c("y", "z").alias("yz"))


@query(f"""WITH d AS (SELECT q.surfel_id AS query_id, p.surfel_id AS point_id, sqrt({_D2}) AS distance, row_number() OVER (PARTITION BY q.surfel_id ORDER BY sqrt({_D2}), p.surfel_id) AS r FROM surfels q, surfels p),
          e AS (SELECT query_id, point_id, distance, avg(distance) OVER w AS m, stddev_pop(distance) OVER w AS s FROM d WHERE r <= 6 WINDOW w AS (PARTITION BY query_id))
          SELECT query_id, point_id, round(distance, 9) AS distance FROM e WHERE s = 0 OR abs(distance - m) / s <= 1.5""", "surfels")
def graph_outlier_edges(spark, sf):
    """Edges of the 6-neighbour graph whose length isn't an outlier among those of their source."""
    from pyspark.sql import Window

    s = surfels(spark, sf)
    w = Window.partitionBy("query_id")
    e = J.k_nearest(s, s, 6).withColumns({"m": F.avg("distance").over(w), "s": F.stddev_pop("distance").over(w)})
    return _rounded(e.where((F.col("s") == 0) | (F.try_divide(F.abs(F.col("distance") - F.col("m")), F.col("s")) <= 1.5)).drop("rank", "m", "s"))


def _two(spark, sf):
    s = surfels(spark, sf)
    return s.where("x > 0"), s.where("y > 0")


for _name, _f, _test in (("set_union", "union", "x > 0 OR y > 0"), ("set_intersect", "intersect", "x > 0 AND y > 0"), ("set_subtract", "subtract", "x > 0 AND NOT y > 0")):
    query(f"SELECT surfel_id FROM surfels WHERE {_test}", "surfels", name=_name)(lambda spark, sf, f=_f: getattr(S, f)(*_two(spark, sf)).select("surfel_id"))
for _name, _column in (("distinct_blocks", "block_id"), ("distinct_objects", "object_id")):
    query(f"SELECT DISTINCT {_column} FROM surfels", "surfels", name=_name)(lambda spark, sf, c=_column: S.distinct(surfels(spark, sf), c))


@query("SELECT surfel_id, CASE WHEN x > 0 THEN 1 ELSE 0 END AS side FROM surfels WHERE x > 0 OR y > 0", "surfels")
def set_upsert(spark, sf):
    a, b = _two(spark, sf)
    return S.upsert(b.select("surfel_id", F.lit(0).alias("side")), a.select("surfel_id", F.lit(1).alias("side")), "surfel_id")
