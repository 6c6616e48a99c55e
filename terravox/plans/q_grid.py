"""Raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.masks import LAPLACE2, LAPLACE3, SOBEL_X, SOBEL_Y
from ..registry import Later, query
from .views import NX, NY, NZ, cells2, cells3, surfels

G = Later("operators.grid")

R2, R3 = (NX, NY), (NX, NY, NZ)


def _r(df, digits: int = 4):
    return df.select(*[c for c in ("grid_id", "ix", "iy", "iz") if c in df.columns], F.round("value", digits).alias("value"))


def _cell(name: str, f, sql: str, three: bool = False, digits: int = 4, extra: str = "") -> None:
    """sql: the value's expression over the view, or a whole query that starts with SELECT or WITH."""
    view = "cells3" if three else "cells2"
    key = "grid_id, ix, iy, iz" if three else "grid_id, ix, iy"
    whole = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT {key}, round({sql}, {digits}) AS value FROM {view}{extra}"
    query(whole, view, name=name)(lambda spark, sf: _r(f((cells3 if three else cells2)(spark, sf)), digits))


def _other(c):
    """A second grid to meet the first: the same one, reflected, with some zeros."""
    return G.reflect(c, R3 if "iz" in c.columns else R2).withColumn("value", F.when(F.col("ix") % 7 == 0, 0.0).otherwise(F.col("value") / 3))


_OTHER2 = "o AS (SELECT 49 - ix AS ix, 10 - iy AS iy, CASE WHEN (49 - ix) % 7 = 0 THEN 0.0::DOUBLE ELSE value / 3 END AS other FROM cells2)"
_OTHER3 = "o AS (SELECT 49 - ix AS ix, 10 - iy AS iy, 6 - iz AS iz, CASE WHEN (49 - ix) % 7 = 0 THEN 0.0::DOUBLE ELSE value / 3 END AS other FROM cells3)"


def _pair(name: str, op: str, value: str, three: bool = False) -> None:
    view, other, key = ("cells3", _OTHER3, "ix, iy, iz") if three else ("cells2", _OTHER2, "ix, iy")
    sql = f"WITH {other} SELECT grid_id, {key}, round({value}, 4) AS value FROM {view} LEFT JOIN o USING ({key})"
    query(sql, view, name=name)(lambda spark, sf: _r((lambda c: G.combine(c, _other(c), op))((cells3 if three else cells2)(spark, sf))))


_cell("grid_abs", lambda c: G.unary(G.apply(c, G.V - 40000), "abs"), "abs(value - 40000)")
_cell("grid_sqrt", lambda c: G.unary(c, "sqrt"), "sqrt(value)")
_cell("grid_square", lambda c: G.unary(c, "square"), "value * value", digits=2)
_cell("grid_negate", lambda c: G.unary(c, "negate"), "-value")
_cell("grid_invert", lambda c: G.unary(c, "invert"), "CASE WHEN abs(value) > 1e-20 THEN 1 / value ELSE value END", True, 9)
_cell("grid_transpose", lambda c: G.reflect(c, R2), "SELECT grid_id, (49 - ix)::INTEGER AS ix, (10 - iy)::INTEGER AS iy, round(value, 4) AS value FROM cells2")
_cell("grid_substitute", lambda c: G.substitute(c, None, -1.0), "coalesce(value, -1)")
_cell("grid_threshold", lambda c: G.threshold(c, 40000, 0.0, None), "CASE WHEN value <= 40000 THEN 0.0::DOUBLE ELSE value END")
_cell("grid_pow2", lambda c: G.power(c, 1.5), "pow(value, 1.5)", digits=2)
_cell("grid_pow3", lambda c: G.power(G.apply(c, G.V - 100), 1.5), "pow(abs(value - 100), 1.5)", True, 2)
_cell("grid_add_scalar", lambda c: G.apply(c, G.V + 2.5), "value + 2.5")
_cell("grid_divide_scalar", lambda c: G.divide_by(c, 7.0), "value / 7")
_pair("grid_add_grid", "add", "value + other")
_pair("grid_sub_grid", "subtract", "value - other")
_pair("grid_mul_grid", "multiply", "value * other")
_pair("grid_div_grid", "divide", "CASE WHEN other <> 0 THEN value / other WHEN other IS NULL THEN NULL WHEN value > 0 THEN 1000000.0::DOUBLE WHEN value < 0 THEN -1000000.0::DOUBLE ELSE value END")
_pair("grid_div_grid3", "divide", "CASE WHEN abs(other) > 1e-20 THEN value / other ELSE value END", True)
_pair("grid_mask", "mask", "CASE WHEN value IS NULL OR other IS NULL THEN NULL WHEN other = 0 THEN 0.0::DOUBLE ELSE value END")
_pair("grid_overlay", "overlay", "CASE WHEN other IS NOT NULL AND other <> 0 THEN other ELSE value END")
_pair("grid_min", "min", "least(value, other)", True)
_pair("grid_max", "max", "greatest(value, other)", True)
_cell("grid_hash", lambda c: G.quantise(c, 16), """SELECT grid_id, ix, iy, least(15, trunc(16 * (value - lo) / (hi - lo)))::DOUBLE AS value FROM cells2, (SELECT min(value) AS lo, max(value) AS hi FROM cells2)""")
_cell("grid_normalize", lambda c: G.normalize(c, divide=True), "SELECT grid_id, ix, iy, iz, round(value / norm, 8) AS value FROM cells3, (SELECT sqrt(sum(value * value)) AS norm FROM cells3)", True, 8)
_cell("grid_du", lambda c: G.forward_difference(c, "ix"), """SELECT grid_id, ix, iy, round(CASE WHEN value <> 0 AND n <> 0 THEN n - value END, 4) AS value FROM (SELECT *, lead(value) OVER (PARTITION BY iy ORDER BY ix) AS n FROM cells2)""")
_cell("grid_dv", lambda c: G.forward_difference(c, "iy"), """SELECT grid_id, ix, iy, round(CASE WHEN value <> 0 AND n <> 0 THEN n - value END, 4) AS value FROM (SELECT *, lead(value) OVER (PARTITION BY ix ORDER BY iy) AS n FROM cells2)""")
_cell("grid_slice", lambda c: c.where("iz = 2").drop("iz"), "SELECT grid_id, ix, iy, round(value, 4) AS value FROM cells3 WHERE iz = 2", True)
_cell("grid_pad", lambda c: G.pad(c, R2, 2), """SELECT 1 AS grid_id, gx.ix, gy.iy, round(CASE WHEN gx.ix BETWEEN 2 AND 51 AND gy.iy BETWEEN 2 AND 12 THEN value ELSE 0.0::DOUBLE END, 4) AS value
      FROM (SELECT unnest(range(54))::INTEGER AS ix) gx CROSS JOIN (SELECT unnest(range(15))::INTEGER AS iy) gy LEFT JOIN cells2 c ON c.ix + 2 = gx.ix AND c.iy + 2 = gy.iy""")
_cell("grid_resample", lambda c: G.resample2(c, R2, (25, 6)), """WITH t AS (SELECT jx, jy, jx * (49.0::DOUBLE / 24) AS gx, jy * (10.0::DOUBLE / 5) AS gy FROM (SELECT unnest(range(25))::INTEGER AS jx) a CROSS JOIN (SELECT unnest(range(6))::INTEGER AS jy) b),
      k AS (SELECT jx, jy, CAST(floor(gx) AS INTEGER) + dx AS ix, CAST(floor(gy) AS INTEGER) + dy AS iy, (CASE dx WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE dy WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) AS w FROM t, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
      s AS (SELECT jx, jy, sum(w * value) / sum(w) AS value FROM k JOIN cells2 c ON c.ix = k.ix AND c.iy = k.iy WHERE value IS NOT NULL AND w > 0 GROUP BY 1, 2)
      SELECT 1 AS grid_id, t.jx AS ix, t.jy AS iy, round(s.value, 3) AS value FROM t LEFT JOIN s USING (jx, jy)""", digits=3)


@query("""SELECT grid_id, min(value) AS minimum, max(value) AS maximum, round(avg(value), 4) AS mean, round(sum(value), 2) AS l1, round(sqrt(sum(value * value)), 2) AS l2,
          round(var_pop(value), 0) AS variance, round(stddev_pop(value), 4) AS stddev, count(*) FILTER (value <> 0) AS cardinality FROM cells2 GROUP BY 1""", "cells2")
def grid_stats(spark, sf):
    s = G.stats(cells2(spark, sf))
    return s.select("grid_id", "minimum", "maximum", F.round("mean", 4).alias("mean"), F.round("l1", 2).alias("l1"), F.round("l2", 2).alias("l2"), F.round("variance", 0).alias("variance"), F.round("stddev", 4).alias("stddev"), "cardinality")


def _percentile(name: str, p: float, three: bool) -> None:
    view = "cells3" if three else "cells2"
    sql = f"WITH v AS (SELECT grid_id, value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM {view} WHERE value IS NOT NULL) SELECT grid_id, value FROM v WHERE r = least(trunc(n * {p}), n - 1)"
    query(sql, view, name=name)(lambda spark, sf: G.percentile((cells3 if three else cells2)(spark, sf), p))


_percentile("grid_percentile", 0.9, False)
_percentile("grid_median", 0.5, True)
_percentile("grid_percentile_one", 1.0, True)


@query("SELECT grid_id, round(sum(value * ix) / sum(value), 6) AS cx, round(sum(value * iy) / sum(value), 6) AS cy, round(sum(value * iz) / sum(value), 6) AS cz FROM cells3 GROUP BY 1", "cells3")
def grid_centroid(spark, sf):
    return G.centroid(cells3(spark, sf), divide=True).select("grid_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")))


@query("""SELECT grid_id, round(sum(value * ix * ix) / sum(value) - (sum(value * ix) / sum(value)) ^ 2, 4) AS mxx, round(sum(value * ix * iy) / sum(value) - (sum(value * ix) / sum(value)) * (sum(value * iy) / sum(value)), 4) AS mxy,
          round(sum(value * iy * iy) / sum(value) - (sum(value * iy) / sum(value)) ^ 2, 4) AS myy FROM cells2 GROUP BY 1""", "cells2")
def grid_covariance(spark, sf):
    return G.covariance(cells2(spark, sf)).select("grid_id", *(F.round(c, 4).alias(c) for c in ("mxx", "mxy", "myy")))


@query(f"WITH {_OTHER2} SELECT grid_id, round(sum(value * other), 0) AS dot, round(sum(abs(value - other)), 2) AS l1_distance, round(sum((value - other) * (value - other)), 0) AS l2_distance_squared FROM cells2 JOIN o USING (ix, iy) GROUP BY 1", "cells2")
def grid_distances(spark, sf):
    c = cells2(spark, sf)
    return G.compare(c, _other(c)).select("grid_id", F.round("dot", 0).alias("dot"), F.round("l1_distance", 2).alias("l1_distance"), F.round("l2_distance_squared", 0).alias("l2_distance_squared"))


# neighbourhoods
def _mask_sql(mask, three: bool) -> str:
    if three:
        values = ", ".join(f"({i % 3 - 1}, {i // 3 % 3 - 1}, {i // 9 - 1}, {float(m)!r}::DOUBLE)" for i, m in enumerate(mask))
        return f"""m(dx, dy, dz, w) AS (VALUES {values}), s AS (SELECT c.ix, c.iy, c.iz, sum(w * t.value) AS v, count(t.value) AS n FROM cells3 c, m JOIN cells3 t ON t.ix = c.ix + dx AND t.iy = c.iy + dy AND t.iz = c.iz + dz GROUP BY ALL)"""
    values = ", ".join(f"({i % 3 - 1}, {i // 3 - 1}, {float(m)!r}::DOUBLE)" for i, m in enumerate(mask))
    return f"""m(dx, dy, w) AS (VALUES {values}), s AS (SELECT c.ix, c.iy, sum(w * t.value) AS v, count(t.value) AS n FROM cells2 c, m JOIN cells2 t ON t.ix = c.ix + dx AND t.iy = c.iy + dy GROUP BY ALL)"""


def _convolution(name: str, f, mask, three: bool = False) -> None:
    key = "ix, iy, iz" if three else "ix, iy"
    inside = "ix BETWEEN 1 AND 48 AND iy BETWEEN 1 AND 9" + " AND iz BETWEEN 1 AND 5" * three + f" AND n = {27 if three else 9}"
    view = "cells3" if three else "cells2"
    sql = f"WITH {_mask_sql(mask, three)} SELECT grid_id, {key}, round(CASE WHEN {inside} THEN v {'ELSE 0.0::DOUBLE ' * three}END + 1.23e-5, 3) AS value FROM {view} LEFT JOIN s USING ({key})"
    query(sql, view, name=name)(lambda spark, sf: _r(G.apply(f((cells3 if three else cells2)(spark, sf)), G.V + 1.23e-5), 3))


_BOX = (1.0,) * 9
_convolution("grid_convolve", lambda c: G.convolve(c, _BOX, R2), _BOX)
_convolution("grid_gradient_x", lambda c: G.gradient(c, "ix", R2), SOBEL_X)
_convolution("grid_gradient_y", lambda c: G.gradient(c, "iy", R2), SOBEL_Y)
_convolution("grid_laplacian2", lambda c: G.convolve(c, LAPLACE2, R2), LAPLACE2)
_convolution("grid_laplacian3", lambda c: G.convolve(c, LAPLACE3, R3), LAPLACE3, True)

_BOTH = f"""gx AS (WITH {_mask_sql(SOBEL_X, False)} SELECT ix, iy, CASE WHEN ix BETWEEN 1 AND 48 AND iy BETWEEN 1 AND 9 AND n = 9 THEN v END AS x FROM s),
gy AS (WITH {_mask_sql(SOBEL_Y, False)} SELECT ix, iy, CASE WHEN ix BETWEEN 1 AND 48 AND iy BETWEEN 1 AND 9 AND n = 9 THEN v END AS y FROM s),
g AS (SELECT grid_id, ix, iy, x, y FROM cells2 LEFT JOIN gx USING (ix, iy) LEFT JOIN gy USING (ix, iy))"""
_cell("grid_gradient_mag", lambda c: G.gradient_magnitude(c, R2), f"WITH {_BOTH} SELECT grid_id, ix, iy, round(sqrt(x * x + y * y), 3) AS value FROM g", digits=3)
_cell("grid_gradient_angle", lambda c: G.gradient_angle(c, R2), f"WITH {_BOTH} SELECT grid_id, ix, iy, round(CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN x = 0 THEN 1.5707963267948966 ELSE atan(y / x) END, 5) AS value FROM g", digits=5)
_cell("grid_harris", lambda c: G.apply(G.harris(c, 1, 0.05, R2), G.V / 1e12), f"""WITH {_BOTH}, t AS (SELECT c.ix, c.iy, sum(w * g.x * g.x) AS xx, sum(w * g.x * g.y) AS xy, sum(w * g.y * g.y) AS yy FROM cells2 c,
      (SELECT dx, dy, exp(-(dx * dx + dy * dy) / 0.5::DOUBLE) AS w FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) o JOIN g ON g.ix = c.ix + dx AND g.iy = c.iy + dy WHERE g.x IS NOT NULL AND g.y IS NOT NULL GROUP BY ALL)
      SELECT grid_id, ix, iy, round((xx * yy - xy * xy - 0.05 * (xx + yy) * (xx + yy)) / 1e12, 3) AS value FROM cells2 LEFT JOIN t USING (ix, iy)""", digits=3)
_cell("grid_hessian", lambda c: G.apply(G.hessian(c, "ix", "ix", R2), G.V + 1.23e-5), f"""WITH {_BOTH}, m2(dx, dy, w) AS (VALUES {", ".join(f"({i % 3 - 1}, {i // 3 - 1}, {float(m)!r}::DOUBLE)" for i, m in enumerate(SOBEL_X))}),
      h AS (SELECT c.ix, c.iy, sum(w * t.x) AS v, count(t.x) AS n FROM g c, m2 JOIN g t ON t.ix = c.ix + dx AND t.iy = c.iy + dy GROUP BY ALL)
      SELECT grid_id, ix, iy, round(CASE WHEN ix BETWEEN 1 AND 48 AND iy BETWEEN 1 AND 9 AND n = 9 THEN v END + 1.23e-5, 3) AS value FROM cells2 LEFT JOIN h USING (ix, iy)""", digits=3)


def _blur_sql(view: str, axis: str, others: str, sigma: float, keep: str) -> str:
    r = int(3 * sigma + 0.5)
    on = " AND ".join(f"t.{o} = c.{o}" for o in others.split(", "))
    return f"""(SELECT {keep}, CASE WHEN c.value IS NOT NULL THEN sum(t.value * exp(-((t.{axis} - c.{axis}) * (t.{axis} - c.{axis})) / {2 * sigma * sigma}::DOUBLE)) / sum(exp(-((t.{axis} - c.{axis}) * (t.{axis} - c.{axis})) / {2 * sigma * sigma}::DOUBLE)) END AS value
        FROM {view} c LEFT JOIN {view} t ON {on} AND t.{axis} BETWEEN c.{axis} - {r} AND c.{axis} + {r} AND t.value IS NOT NULL GROUP BY {keep}, c.value)"""


_K2 = "c.grid_id, c.ix, c.iy"
_cell("grid_blur_x", lambda c: G.blur_axis(c, "ix", 1.0), f"SELECT grid_id, ix, iy, round(value, 3) AS value FROM {_blur_sql('cells2', 'ix', 'iy', 1.0, _K2)}", digits=3)
_cell("grid_blur", lambda c: G.blur(c, 1.0), f"WITH b1 AS {_blur_sql('cells2', 'ix', 'iy', 1.0, _K2)} SELECT grid_id, ix, iy, round(value, 3) AS value FROM {_blur_sql('b1', 'iy', 'ix', 1.0, _K2)}", digits=3)
_cell("grid_bilateral", lambda c: G.bilateral(c, 0.6, 20000.0), """SELECT c.grid_id, c.ix, c.iy, round(sum(w * t.value) / sum(w), 3) AS value FROM cells2 c LEFT JOIN LATERAL (
      SELECT t.value, exp(-((t.ix - c.ix) ^ 2 + (t.iy - c.iy) ^ 2) / 0.72::DOUBLE) * exp(-((t.value - c.value) * (t.value - c.value)) / 800000000.0::DOUBLE) AS w FROM cells2 t
      WHERE (t.ix - c.ix) ^ 2 + (t.iy - c.iy) ^ 2 <= 4 AND t.value IS NOT NULL AND c.value IS NOT NULL) t ON true GROUP BY ALL""", digits=3)


def _ball(name: str, p: float, three: bool) -> None:
    view, key = ("cells3", "ix, iy, iz") if three else ("cells2", "ix, iy")
    near = " + ".join(f"(t.{a} - c.{a}) ^ 2" for a in key.split(", "))
    got = {0.0: "min(t.value)", 1.0: "max(t.value)"}.get(p, f"list_sort(list(t.value))[least(trunc(count(*) * {p}), count(*) - 1)::INTEGER + 1]")
    keys = ", ".join(f"c.{a}" for a in key.split(", "))
    sql = f"SELECT c.grid_id, {keys}, round(CASE WHEN c.value IS NOT NULL THEN {got} END, 4) AS value FROM {view} c JOIN {view} t ON {near} <= {4 if not three else 1} AND t.value IS NOT NULL GROUP BY c.grid_id, {keys}, c.value UNION ALL SELECT grid_id, {key}, NULL FROM {view} c WHERE NOT EXISTS (SELECT 1 FROM {view} t WHERE {near} <= {4 if not three else 1} AND t.value IS NOT NULL)"
    query(sql, view, name=name)(lambda spark, sf: _r(G.percentile_filter((cells3 if three else cells2)(spark, sf), 1 if three else 2, p)))


_ball("grid_min_filter", 0.0, False)
_ball("grid_max_filter", 1.0, False)
_ball("grid_median_filter", 0.5, False)
_ball("grid_median_filter3", 0.5, True)
_cell("grid_local_max_mask", lambda c: G.mask_non_extrema(c, 1, True), """SELECT c.grid_id, c.ix, c.iy, c.iz, round(CASE WHEN c.value < max(t.value) THEN 0.0::DOUBLE ELSE c.value END, 4) AS value
      FROM cells3 c JOIN cells3 t ON (t.ix - c.ix) ^ 2 + (t.iy - c.iy) ^ 2 + (t.iz - c.iz) ^ 2 <= 1 GROUP BY c.grid_id, c.ix, c.iy, c.iz, c.value""", True)
_cell("grid_fill_gaps", lambda c: G.fill_gaps(c, "ix", 3), """SELECT grid_id, ix, iy, round(coalesce(value, CASE WHEN i2 - i1 - 1 < 3 THEN v1 + (ix - i1) / (i2 - i1)::DOUBLE * (v2 - v1) END), 3) AS value FROM (
      SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ix END IGNORE NULLS) OVER b AS i1, last_value(value IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN value IS NOT NULL THEN ix END IGNORE NULLS) OVER a AS i2, first_value(value IGNORE NULLS) OVER a AS v2
      FROM cells2 WINDOW b AS (PARTITION BY iy ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY iy ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", digits=3)


# sampling and rasterization
_SPLAT = """k AS (SELECT surfel_id, CAST(floor(gx) AS INTEGER) + dx AS ix, CAST(floor(gy) AS INTEGER) + dy AS iy, CAST(floor(gz) AS INTEGER) + dz AS iz,
      (CASE dx WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE dy WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE dz WHEN 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END) AS w
      FROM (SELECT surfel_id, (x + 0.4) * 10 AS gx, (y + 0.4) * 10 AS gy, (z + 0.4) * 5 AS gz FROM surfels), (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dz) WHERE gx BETWEEN 0 AND 8 AND gy BETWEEN 0 AND 8 AND gz BETWEEN 0 AND 4)"""
def _at():
    return (F.col("x") + 0.4) * 10, (F.col("y") + 0.4) * 10, (F.col("z") + 0.4) * 5



@query(f"WITH {_SPLAT} SELECT ix, iy, iz, round(sum(w), 6) AS value FROM k WHERE w <> 0 GROUP BY ALL", "surfels")
def splat_point3(spark, sf):
    return G.splat(surfels(spark, sf), _at(), F.lit(1.0), (9, 9, 5)).withColumn("value", F.round("value", 6))


@query("""SELECT ix, iy, round(sum(w * m), 6) AS value FROM (SELECT CAST(floor(gx) AS INTEGER) + dx AS ix, CAST(floor(gy) AS INTEGER) + dy AS iy, m,
      (CASE dx WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE dy WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) AS w
      FROM (SELECT (x + 0.4) * 10 AS gx, (y + 0.4) * 10 AS gy, abs(z) AS m FROM surfels), (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy) WHERE gx BETWEEN 0 AND 8 AND gy BETWEEN 0 AND 8) WHERE w * m <> 0 GROUP BY ALL""", "surfels")
def splat_point2(spark, sf):
    return G.splat(surfels(spark, sf), _at()[:2], F.abs("z"), (9, 9)).withColumn("value", F.round("value", 6))


@query("""WITH k AS (SELECT CAST(floor((x + 0.4) * 10) AS INTEGER) AS ix, CAST(floor((y + 0.4) * 10) AS INTEGER) AS iy, count(*) AS n, round(avg(z), 6) AS mean_z FROM surfels
      WHERE x BETWEEN -0.3 AND 0.3 AND y BETWEEN -0.3 AND 0.3 AND z BETWEEN -0.3 AND 0.3 GROUP BY ALL) SELECT * FROM k""", "surfels")
def density_grid(spark, sf):
    """The flagship: a constraint scan, then points and mean height in each cell of an overhead grid."""
    from ..operators import predicates as P

    points = P.scan(surfels(spark, sf), P.box((-0.3,) * 3, (0.3,) * 3))
    cell = [F.floor((F.col(a) + 0.4) * 10).cast("int").alias(f"i{a}") for a in "xy"]
    return points.groupBy(*cell).agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_z"))


@query("""SELECT surfel_id, round(sum(w * coalesce(value, 0)), 3) AS value FROM (SELECT surfel_id, CAST(floor(gx) AS INTEGER) + dx AS ix, CAST(floor(gy) AS INTEGER) + dy AS iy, CAST(floor(gz) AS INTEGER) + dz AS iz,
      (CASE dx WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE dy WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE dz WHEN 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END) AS w
      FROM (SELECT surfel_id, (x + 0.4) * 60 AS gx, (y + 0.4) * 12 AS gy, (z + 0.4) * 8 AS gz FROM surfels), (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dz)) k LEFT JOIN cells3 USING (ix, iy, iz) GROUP BY 1""", "surfels", "cells3")
def grid_sample_trilinear(spark, sf):
    got = G.sample3(surfels(spark, sf), cells3(spark, sf), ((F.col("x") + 0.4) * 60, (F.col("y") + 0.4) * 12, (F.col("z") + 0.4) * 8), "value")
    return got.select("surfel_id", F.round("value", 3).alias("value"))


def _shape(name: str, resolution, test: str) -> None:
    key = ["ix", "iy", "iz"][: len(resolution)]
    domain = " CROSS JOIN ".join(f"(SELECT unnest(range({n}))::INTEGER AS {a})" for a, n in zip(key, resolution, strict=True))
    query(f"SELECT {', '.join(key)}, 1.0::DOUBLE AS value FROM {domain} WHERE {test}", name=name)(lambda spark, sf: G.shape(spark, resolution, F.expr(test)))


_shape("raster_box", (20, 20, 10), "ix BETWEEN 3 AND 12 AND iy BETWEEN 5 AND 9 AND iz BETWEEN 1 AND 8")
_shape("raster_circle", (40, 40), "(ix - 20) * (ix - 20) + (iy - 18) * (iy - 18) <= 81")
_shape("raster_sphere", (20, 20, 20), "(ix - 9) * (ix - 9) + (iy - 10) * (iy - 10) + (iz - 8) * (iz - 8) <= 36")
_shape("raster_plane", (16, 16, 16), "abs(2 * ix + iy - 2 * iz - 10) * 2 <= 3")


@query("""WITH s AS (SELECT (x + 0.4) * 50 AS ax, (y + 0.4) * 50 AS ay, (nx + 0.4) * 50 AS ex, (ny + 0.4) * 50 AS ey FROM surfels),
      n AS (SELECT *, ceil(greatest(abs(ex - ax), abs(ey - ay)))::INTEGER AS n FROM s), i AS (SELECT *, unnest(range(n + 1)) AS i FROM n)
      SELECT trunc(ax + coalesce(i / nullif(n, 0)::DOUBLE, 0) * (ex - ax) + 0.5)::INTEGER AS ix, trunc(ay + coalesce(i / nullif(n, 0)::DOUBLE, 0) * (ey - ay) + 0.5)::INTEGER AS iy, count(*)::DOUBLE AS value FROM i GROUP BY ALL""", "surfels")
def raster_span(spark, sf):
    own = surfels(spark, sf)
    at = lambda c: (F.col(c) + 0.4) * 50
    return G.span(own, ((at("x"), at("nx")), (at("y"), at("ny"))))
