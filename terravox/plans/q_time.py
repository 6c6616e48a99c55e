"""As-of joins and ordered windows over scanlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Later, query
from .views import scanlines

A = Later("operators.asof")

_SPLIT = """s AS (SELECT * FROM scanlines WHERE kind <> 'click'), q AS (SELECT survey_id, scanline_id AS query_id, timestamp AS t FROM scanlines WHERE kind = 'click' AND survey_id IN (SELECT survey_id FROM s)),
 m AS (SELECT q.*, max(s.timestamp) FILTER (s.timestamp <= q.t) AS bt, min(s.timestamp) FILTER (s.timestamp >= q.t) AS at_, min(s.timestamp) AS lo, max(s.timestamp) AS hi FROM q JOIN s USING (survey_id) GROUP BY ALL)"""


def _sides(spark, sf):
    s = scanlines(spark, sf)
    lines = s.where("kind <> 'click'")
    queries = s.where("kind = 'click'").select("survey_id", F.col("scanline_id").alias("query_id"), "timestamp").join(lines.select("survey_id").distinct(), "survey_id", "left_semi")
    return queries, lines


@query(f"WITH {_SPLIT} SELECT survey_id, query_id, round(coalesce(bt, lo), 6) AS before_t, round(coalesce(at_, hi), 6) AS after_t FROM m", "scanlines")
def asof_before(spark, sf):
    return A.asof(*_sides(spark, sf), "survey_id").select("survey_id", "query_id", F.round("before_t", 6).alias("before_t"), F.round("after_t", 6).alias("after_t"))


@query(f"""WITH {_SPLIT}, f AS (SELECT survey_id, timestamp, max_by(px, scanline_id) AS plast, min_by(px, scanline_id) AS pfirst FROM s GROUP BY 1, 2)
          SELECT m.survey_id, query_id, round(b.plast + CASE WHEN a.timestamp > b.timestamp THEN greatest(0, least(1, (m.t - b.timestamp) / (a.timestamp - b.timestamp))) ELSE 0 END * (a.pfirst - b.plast), 5) AS px
          FROM m JOIN f b ON b.survey_id = m.survey_id AND b.timestamp = coalesce(bt, lo) JOIN f a ON a.survey_id = m.survey_id AND a.timestamp = coalesce(at_, hi)
          WHERE bt IS NOT NULL AND at_ IS NOT NULL""", "scanlines")
def asof_interpolate(spark, sf):
    found = A.interpolate(A.asof(*_sides(spark, sf), "survey_id", carry=("px",)), ("px",))
    return found.where(F.col("timestamp").between(F.col("before_t"), F.col("after_t"))).select("survey_id", "query_id", F.round("px", 5).alias("px"))


@query("""WITH r AS (SELECT survey_id, kind AS range_id, min(timestamp) AS first_t, max(timestamp) AS last_t FROM scanlines WHERE kind <> 'click' GROUP BY 1, 2)
          SELECT survey_id, query_id, range_id FROM (SELECT q.survey_id, q.scanline_id AS query_id, range_id, row_number() OVER (PARTITION BY q.scanline_id ORDER BY first_t, range_id) AS n
          FROM scanlines q JOIN r ON r.survey_id = q.survey_id AND q.timestamp BETWEEN first_t AND last_t WHERE q.kind = 'click') WHERE n = 1""", "scanlines")
def interval_scan(spark, sf):
    queries, lines = _sides(spark, sf)
    ranges = lines.groupBy("survey_id", F.col("kind").alias("range_id")).agg(F.min("timestamp").alias("first_t"), F.max("timestamp").alias("last_t"))
    return A.interval_scan(queries, ranges, "survey_id")


_STEP = "sqrt((px - lag(px) OVER w) * (px - lag(px) OVER w) + (py - lag(py) OVER w) * (py - lag(py) OVER w))"


@query(f"""SELECT scanline_id, round(sum(step) OVER (PARTITION BY survey_id ORDER BY timestamp, scanline_id ROWS UNBOUNDED PRECEDING), 4) AS travel_distance
          FROM (SELECT *, coalesce({_STEP}, 0) AS step FROM scanlines WINDOW w AS (PARTITION BY survey_id ORDER BY timestamp, scanline_id))""", "scanlines")
def travel_distance(spark, sf):
    out = A.travel_distance(scanlines(spark, sf), "survey_id", ("px", "py"), ("timestamp", "scanline_id"))
    return out.select("scanline_id", F.round("travel_distance", 4).alias("travel_distance"))


@query(f"SELECT survey_id, round(sum(step), 4) AS length FROM (SELECT *, coalesce({_STEP}, 0) AS step FROM scanlines WINDOW w AS (PARTITION BY survey_id ORDER BY timestamp, scanline_id)) GROUP BY 1", "scanlines")
def polyline_length(spark, sf):
    out = A.polyline_length(scanlines(spark, sf), "survey_id", ("px", "py"), ("timestamp", "scanline_id"))
    return out.withColumn("length", F.round("length", 4))


@query("""WITH e AS (SELECT survey_id, px, py, coalesce(lead(px) OVER w, first_value(px) OVER w) AS nx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS ny FROM scanlines
            WINDOW w AS (PARTITION BY survey_id ORDER BY timestamp, scanline_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
          SELECT survey_id, round(CASE WHEN count(*) < 3 THEN 0 ELSE sum(px * ny - nx * py) / 2 END, 3) AS area, round(sum(sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py))), 3) AS perimeter, round(avg(px), 6) AS cx FROM e GROUP BY 1""", "scanlines")
def polygon_area(spark, sf):
    out = A.polygon_measures(scanlines(spark, sf), "survey_id", "px", "py", ("timestamp", "scanline_id"))
    return out.select("survey_id", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"), F.round("cx", 6).alias("cx"))


@query("""SELECT scanline_id, round(-0.0703125 * a + 0.8671875 * px + 0.2265625 * b - 0.0234375 * c + 1.23e-7, 4) AS spx FROM (SELECT scanline_id, px, lag(px) OVER w AS a, lead(px) OVER w AS b, lead(px, 2) OVER w AS c FROM scanlines
          WINDOW w AS (PARTITION BY survey_id ORDER BY timestamp, scanline_id)) WHERE a IS NOT NULL AND c IS NOT NULL""", "scanlines")
def catmull_rom(spark, sf):
    out = A.catmull_rom(scanlines(spark, sf), "survey_id", ("px",), ("timestamp", "scanline_id"), 0.25)
    return out.select("scanline_id", F.round(F.col("spx") + 1.23e-7, 4).alias("spx"))


@query("""SELECT scanline_id, round(coalesce(lead(px) OVER w, px) - coalesce(lag(px) OVER w, px), 6) AS dpx FROM scanlines WINDOW w AS (PARTITION BY survey_id ORDER BY timestamp, scanline_id)""", "scanlines")
def polyline_derivative(spark, sf):
    return A.derivative(scanlines(spark, sf), "survey_id", ("px",), ("timestamp", "scanline_id")).select("scanline_id", F.round("dpx", 6).alias("dpx"))
