"""Views that read the test tables as spatial data, in DataFrames and in SQL.

surfels   one point per embedding: position, normal, object, block
cells2    50 x 11 raster over all line items (the full domain): how far a cell's prices lie from those of its column's other
          cells, on a scale of 0 upwards around 40,000; NULL where a cell has few rows for this table
cells3    50 x 11 x 7 raster like it, 0 but in cells with many rows
props     two properties per part
scanlines events per user in time order
tree      region, nation, customer and order as one hierarchy
assignments  label assignments of orders
points2   events as 2D points
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NX, NY, NZ = 50, 11, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surfels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    vid = F.col("vec_id")
    return e.select(
        vid.alias("surfel_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), at(3).alias("nx"), at(4).alias("ny"), at(5).alias("nz"),
        F.col("label").cast("long").alias("object_id"), F.floor(vid / 64).cast("long").alias("block_id"), (vid * 7 % 256).cast("long").alias("flags"), (vid * 0.5).alias("timestamp"), at(6).alias("elevation"),
    )


def _scores(axis: str, name: str) -> str:
    """scored: each cell's value, and its number of rows in standard deviations from the mean of all cells (of its layer)."""
    layer = "PARTITION BY iz" if name else ""
    return f"""WITH sums AS (SELECT trunc(l_quantity)::INTEGER - 1 AS ix, round(l_discount * 100)::INTEGER AS iy{axis}, round(sum(l_extendedprice), 2) AS price, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
        scored AS (SELECT ix, iy{name}, greatest(0.0::DOUBLE, round(40000 + coalesce(20000 * (price - avg(price) OVER c) / nullif(stddev_pop(price) OVER c, 0), 0), 2)) AS value,
                          coalesce((n - avg(n) OVER l) / nullif(stddev_pop(n) OVER l, 0), 0) AS rows
                   FROM sums WINDOW c AS (PARTITION BY ix{name}), l AS ({layer}))"""


SQL = {
    "surfels": """SELECT vec_id AS surfel_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
        CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz,
        CAST(label AS BIGINT) AS object_id, vec_id // 64 AS block_id, vec_id * 7 % 256 AS flags, vec_id * 0.5::DOUBLE AS timestamp, CAST(embedding[7] AS DOUBLE) AS elevation FROM embeddings""",
    "cells2": f"""SELECT 1 AS grid_id, gx.ix, gy.iy, c.value FROM (SELECT unnest(range(50))::INTEGER AS ix) gx CROSS JOIN (SELECT unnest(range(11))::INTEGER AS iy) gy
        LEFT JOIN ({_scores("", "")} SELECT ix, iy, value FROM scored WHERE rows >= -0.5) c ON c.ix = gx.ix AND c.iy = gy.iy""",
    "cells3": f"""SELECT 1 AS grid_id, gx.ix, gy.iy, gz.iz, coalesce(c.value, 0.0::DOUBLE) AS value FROM (SELECT unnest(range(50))::INTEGER AS ix) gx CROSS JOIN (SELECT unnest(range(11))::INTEGER AS iy) gy
        CROSS JOIN (SELECT unnest(range(7))::INTEGER AS iz) gz
        LEFT JOIN ({_scores(", (l_linenumber - 1)::INTEGER AS iz", ", iz")} SELECT ix, iy, iz, value FROM scored WHERE rows >= 0.8) c ON c.ix = gx.ix AND c.iy = gy.iy AND c.iz = gz.iz""",
    "props": "SELECT p_partkey AS vertex_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size, p_retailprice AS price FROM part",
    "scanlines": "SELECT event_id AS scanline_id, user_id AS survey_id, epoch_us(ts) / 1000000.0::DOUBLE AS timestamp, value AS px, CAST(event_id % 1000 AS DOUBLE) AS py, event_type AS kind FROM events",
    "points2": "SELECT event_id AS point_id, value AS x, CAST(user_id AS DOUBLE) AS y, event_type AS kind FROM events",
    "tree": """SELECT 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0.0::DOUBLE AS size FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.0 FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer
        UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_totalprice FROM orders""",
    "assignments": "SELECT o_custkey AS object_id, o_orderpriority AS label, o_orderkey AS place, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS originator, o_totalprice AS confidence FROM orders",
}


def _domain(spark: SparkSession, *sizes: tuple[str, int]) -> DataFrame:
    """All cells of a small grid; sizes are the grid's resolution, so the row count is fixed."""
    (name, n), *rest = sizes
    out = spark.range(n).select(F.col("id").cast("int").alias(name))
    for name, n in rest:
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    return out


def _scored(spark: SparkSession, sf_dir: str, *more: F.Column) -> DataFrame:
    """Cells with their value, and their number of rows in standard deviations from the mean (of their layer). Windows see cells only, a fixed number."""
    own = table(spark, sf_dir, "lineitem")
    own = own.select((F.col("l_quantity").cast("int") - 1).alias("ix"), F.round(F.col("l_discount") * 100).cast("int").alias("iy"), *more, "l_extendedprice")
    cell = [c for c in own.columns if c != "l_extendedprice"]
    sums = own.groupBy(*cell).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").cast("double").alias("n"))
    layer = ["iz"] if "iz" in cell else []
    column, level = Window.partitionBy("ix", *layer), Window.partitionBy(*layer)
    off = lambda c, w: F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0))
    value = F.greatest(F.lit(0.0), F.round(40000 + 20000 * off("price", column), 2))
    return sums.select(*cell, value.alias("value"), off("n", level).alias("rows"))


def cells2(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scored(spark, sf_dir).where("rows >= -0.5").drop("rows")
    return _domain(spark, ("ix", NX), ("iy", NY)).join(own, ["ix", "iy"], "left").select(F.lit(1).alias("grid_id"), "ix", "iy", "value")


def cells3(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scored(spark, sf_dir, (F.col("l_linenumber") - 1).cast("int").alias("iz")).where("rows >= 0.8").drop("rows")
    return _domain(spark, ("ix", NX), ("iy", NY), ("iz", NZ)).join(own, ["ix", "iy", "iz"], "left").select(F.lit(1).alias("grid_id"), "ix", "iy", "iz", F.coalesce("value", F.lit(0.0)).alias("value"))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("vertex_id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("double")).alias("size"), F.col("p_retailprice").alias("price"))


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("scanline_id"), F.col("user_id").alias("survey_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"), F.col("value").alias("px"), (F.col("event_id") % 1000).cast("double").alias("py"), F.col("event_type").alias("kind"))


def points2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("point_id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("event_type").alias("kind"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    zero = F.lit(0.0).alias("size")
    r = t("region").select(key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), zero)
    n = t("nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), zero)
    c = t("customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), "c_acctbal")
    o = t("orders").select(key("o", "o_orderkey"), key("c", "o_custkey"), "o_totalprice")
    return r.union(n).union(c).union(o)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    who = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.select(F.col("o_custkey").alias("object_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("place"), who.alias("originator"), F.col("o_totalprice").alias("confidence"))


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """SQL with the named views in front; a WITH of its own goes on after them."""
    if not views:
        return sql
    lead = ",\n".join(f"{v} AS ({SQL[v]})" for v in views)
    body = sql.strip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{word}{lead},\n{body[len(word):]}"
    return f"WITH {lead}\n{body}"
