"""Queries over vertex properties and their graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import Later, query
from .views import props, table

P = Later("operators.props")


def graph(spark, sf):
    """Edges between parts that an order has in common lines: consecutive line numbers, both directions, one row a pair."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("v0"))
    e = a.join(li.withColumnRenamed("l_partkey", "v1"), ["l_orderkey", "l_linenumber"]).where("v0 <> v1").select("v0", "v1")
    return e.union(e.select(F.col("v1").alias("v0"), F.col("v0").alias("v1"))).distinct()


_GRAPH = """graph AS (SELECT DISTINCT v0, v1 FROM (SELECT a.l_partkey AS v0, b.l_partkey AS v1 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey
  UNION ALL SELECT b.l_partkey, a.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey))"""


@query("""SELECT round(avg(size), 6) AS mean, min(size) AS minimum, max(size) AS maximum, round(stddev_pop(size), 6) AS stddev, round(var_pop(size), 5) AS variance, sum(abs(size)) AS l1,
          round(sqrt(sum(size * size)), 6) AS l2, count(*) FILTER (size <> 0) AS nonzero FROM props""", "props")
def prop_stats(spark, sf):
    s = P.stats(props(spark, sf), "size")
    return s.select(F.round("mean", 6).alias("mean"), "minimum", "maximum", F.round("stddev", 6).alias("stddev"), F.round("variance", 5).alias("variance"), "l1", F.round("l2", 6).alias("l2"), "nonzero")


def _percentile(name: str, column: str, p: float) -> None:
    sql = f"SELECT {column} AS value FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS r, count(*) OVER () AS n FROM props WHERE {column} IS NOT NULL) WHERE r = least(n - 1, trunc(n * {p} / 100.0::DOUBLE))"
    query(sql, "props", name=name)(lambda spark, sf: P.percentile(props(spark, sf), column, p))


_percentile("prop_percentile", "price", 90)
_percentile("prop_median", "size", 50)
_percentile("prop_percentile_top", "price", 100)


@query("""WITH e AS (SELECT (SELECT size FROM (SELECT size, row_number() OVER (ORDER BY size) - 1 AS r, count(*) OVER () AS n FROM props WHERE size IS NOT NULL) WHERE r = trunc(n * 0.01::DOUBLE)) AS p1,
            (SELECT size FROM (SELECT size, row_number() OVER (ORDER BY size) - 1 AS r, count(*) OVER () AS n FROM props WHERE size IS NOT NULL) WHERE r = least(n - 1, trunc(n * 0.99::DOUBLE))) AS p99),
          b AS (SELECT greatest(0, least(49, (size - p1) * 49 / (p99 - p1))) AS pos FROM props, e WHERE size IS NOT NULL),
          h AS (SELECT bin, sum(w) AS w FROM (SELECT floor(pos) AS bin, 1 - (pos - floor(pos)) AS w FROM b UNION ALL SELECT least(floor(pos) + 1, 49), pos - floor(pos) FROM b) WHERE w > 0 GROUP BY bin)
          SELECT round(-sum(w / t * log2(w / t)), 6) AS entropy FROM h, (SELECT sum(w) AS t FROM h)""", "props")
def prop_entropy(spark, sf):
    return P.entropy(props(spark, sf), "size").select(F.round("entropy", 6).alias("entropy"))


@query("SELECT vertex_id, round((size - (SELECT avg(size) FROM props)) / (SELECT stddev_pop(size) FROM props), 6) AS size FROM props", "props")
def prop_normalize(spark, sf):
    return P.normalize(props(spark, sf), "size").select("vertex_id", F.round("size", 6).alias("size"))


@query("""SELECT vertex_id, round(CASE WHEN size IS NOT NULL THEN 100.0::DOUBLE * (row_number() OVER (PARTITION BY size IS NULL ORDER BY size, vertex_id) - 1) / count(*) OVER () END, 6) AS size FROM props""", "props")
def prop_percentilize(spark, sf):
    return P.percentilize(props(spark, sf), "size").select("vertex_id", F.round("size", 6).alias("size"))


def _simple(name: str, f, value: str, column: str = "size") -> None:
    query(f"SELECT vertex_id, round({value}, 6) AS {column} FROM props", "props", name=name)(lambda spark, sf: f(props(spark, sf)).select("vertex_id", F.round(column, 6).alias(column)))


_simple("prop_threshold", lambda p: P.threshold(p, "size", 25, 0.0, None), "CASE WHEN size <= 25 THEN 0.0::DOUBLE ELSE size END")
_simple("prop_mask", lambda p: P.mask(p.withColumn("m", F.when(F.col("vertex_id") % 3 == 0, 0.0).otherwise(1.0)), "size", "m"), "CASE WHEN size IS NULL THEN NULL WHEN vertex_id % 3 = 0 THEN 0.0::DOUBLE ELSE size END")
_simple("prop_add", lambda p: P.arithmetic(p, "size", "add", "price"), "size + price")
_simple("prop_sub", lambda p: P.arithmetic(p, "size", "subtract", 3), "size - 3")
_simple("prop_mul", lambda p: P.arithmetic(p, "size", "multiply", "price"), "size * price")
_simple("prop_div", lambda p: P.arithmetic(p, "price", "divide", "size"), "CASE WHEN size IS NOT NULL AND size <> 0 THEN price / size ELSE price END", "price")
_simple("prop_pow", lambda p: P.arithmetic(p, "size", "pow", 2), "pow(size, 2)")
_simple("prop_invert", lambda p: P.unary(p, "size", "invert"), "CASE WHEN size <> 0 THEN 1 / size ELSE size END")
_simple("prop_sqrt", lambda p: P.unary(p, "price", "sqrt"), "sqrt(price)", "price")
_simple("prop_negate", lambda p: P.unary(p, "size", "negate"), "-size")
_simple("prop_substitute", lambda p: P.substitute(p, "size", None, -1.0), "coalesce(size, -1)")
_simple("prop_select", lambda p: P.select(p, "price"), "price", "price")
_simple("prop_rename", lambda p: P.rename(p, "size", "extent"), "size", "extent")
_simple("prop_insert", lambda p: P.insert(p, "double", F.col("size") * 2), "size * 2", "double")
_simple("prop_merge", lambda p: P.merge(p, p.withColumn("size", F.col("size") + 1)), "size + 1", "size_2")


@query("SELECT round(sum(size * price), 2) AS dot FROM props", "props")
def prop_dot(spark, sf):
    return P.dot(props(spark, sf), "size", "price").select(F.round("dot", 2).alias("dot"))


@query(f"""WITH {_GRAPH}, n AS (SELECT v0, max(u.price) AS best FROM graph JOIN props u ON u.vertex_id = v1 WHERE u.price IS NOT NULL GROUP BY v0)
          SELECT p.vertex_id, p.price FROM props p LEFT JOIN n ON n.v0 = p.vertex_id WHERE p.price IS NOT NULL AND (best IS NULL OR p.price > best)""", "props")
def prop_local_extrema(spark, sf):
    return P.local_extrema(props(spark, sf), "price", graph(spark, sf), True)


@query(f"""WITH {_GRAPH}, n AS (SELECT v0, avg(u.size) AS m FROM graph JOIN props u ON u.vertex_id = v1 WHERE u.size IS NOT NULL GROUP BY v0)
          SELECT vertex_id, round(CASE WHEN size IS NULL THEN NULL WHEN m IS NULL THEN 0.0::DOUBLE ELSE size - m END, 6) AS size FROM props LEFT JOIN n ON v0 = vertex_id""", "props")
def prop_laplacian(spark, sf):
    return P.laplacian(props(spark, sf), "size", graph(spark, sf).withColumn("weight", F.lit(1.0))).select("vertex_id", F.round("size", 6).alias("size"))


@query(f"""WITH {_GRAPH}, d AS (SELECT v0, v1, 1.0::DOUBLE AS distance FROM graph UNION ALL SELECT vertex_id, vertex_id, 0.0::DOUBLE FROM props),
          n AS (SELECT v0, sum(u.size * exp(-distance * distance / 2)) / sum(exp(-distance * distance / 2)) AS b FROM d JOIN props u ON u.vertex_id = v1 WHERE u.size IS NOT NULL GROUP BY v0)
          SELECT vertex_id, round(CASE WHEN size IS NOT NULL THEN b END, 6) AS size FROM props LEFT JOIN n ON v0 = vertex_id""", "props")
def prop_blur(spark, sf):
    p = props(spark, sf)
    d = graph(spark, sf).withColumn("distance", F.lit(1.0)).union(p.select(F.col("vertex_id").alias("v0"), F.col("vertex_id").alias("v1"), F.lit(0.0)))
    return P.blur(p, "size", d, 1.0).select("vertex_id", F.round("size", 6).alias("size"))
