"""Scanlines in time: as-of joins, interpolated poses, travelled distance, polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(queries: DataFrame, lines: DataFrame, key: str, at: str = "timestamp", ident: str = "scanline_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each query row with the last line not after it and the first one after; clamped to the first or last line at the ends.

    Both sides meet in one sorted stream for each key (a union and a window), so there is one shuffle and no pairs.
    queries: key, query_id, at. Adds before_id, after_id, before_t, after_t and before_/after_ of the carried columns."""
    fields = [F.col(at).alias("t"), F.col(ident).alias("id"), *carry]
    sent = lines.select(key, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct(*fields).alias("_line"), F.lit(None).cast("long").alias("query_id"))
    asked = queries.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(sent.schema["_line"].dataType).alias("_line"), F.col("query_id").cast("long").alias("query_id"))
    order = [F.col("_t"), F.col("_side"), F.col("_line.id")]
    w = Window.partitionBy(key).orderBy(*order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    both = sent.union(asked).withColumns({"_before": F.last("_line", True).over(back), "_after": F.first("_line", True).over(on)})
    got = both.where("_side = 1").withColumns({"_b": F.coalesce("_before", "_after"), "_a": F.when(F.col("_before.t") == F.col("_t"), F.col("_before")).otherwise(F.coalesce("_after", "_before"))})
    named = lambda s, n: [F.col(f"{s}.id").alias(f"{n}_id"), F.col(f"{s}.t").alias(f"{n}_t"), *(F.col(f"{s}.{c}").alias(f"{n}_{c}") for c in carry)]
    return got.select(key, "query_id", F.col("_t").alias(at), *named("_b", "before"), *named("_a", "after"))


def interpolate(found: DataFrame, columns: tuple[str, ...], at: str = "timestamp") -> DataFrame:
    """Linear between the two lines of asof(); constant beyond the ends."""
    t = F.coalesce(F.try_divide(F.col(at) - F.col("before_t"), F.col("after_t") - F.col("before_t")), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return found.withColumns({c: F.col(f"before_{c}") + t * (F.col(f"after_{c}") - F.col(f"before_{c}")) for c in columns})


def interval_scan(queries: DataFrame, ranges: DataFrame, key: str, at: str = "timestamp") -> DataFrame:
    """The first range (by start, then id) that admits each query's time. ranges: key, range_id, first_t, last_t."""
    met = queries.join(ranges, key).where(F.col(at).between(F.col("first_t"), F.col("last_t")))
    return met.groupBy(key, "query_id").agg(F.min(F.struct("first_t", "range_id")).alias("m")).select(key, "query_id", F.col("m.range_id").alias("range_id"))


def travel_distance(lines: DataFrame, key: str, coordinates: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Cumulative distance along each key's lines in order, 0 at the first."""
    w = Window.partitionBy(key).orderBy(*order)
    d2 = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in coordinates), F.lit(0.0))
    stepped = lines.withColumn("step", F.coalesce(F.sqrt(d2), F.lit(0.0)))
    return stepped.withColumn("travel_distance", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def polyline_length(lines: DataFrame, key: str, coordinates: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    return travel_distance(lines, key, coordinates, order).groupBy(key).agg(F.sum("step").alias("length"))


def polygon_measures(corners: DataFrame, key: str, x: str, y: str, order: tuple[str, ...]) -> DataFrame:
    """Signed shoelace area (0 for fewer than 3 corners), perimeter and the mean of the corners."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead(x).over(w), F.first(x).over(whole)), F.coalesce(F.lead(y).over(w), F.first(y).over(whole))
    edges = corners.withColumns({"cross": F.col(x) * ny - nx * F.col(y), "edge": F.sqrt((nx - F.col(x)) * (nx - F.col(x)) + (ny - F.col(y)) * (ny - F.col(y)))})
    return edges.groupBy(key).agg(F.when(F.count("*") < 3, 0.0).otherwise(F.sum("cross") / 2).alias("area"), F.sum("edge").alias("perimeter"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))


def catmull_rom(points: DataFrame, key: str, coordinates: tuple[str, ...], order: tuple[str, ...], t: float, tao: float = 0.5) -> DataFrame:
    """The spline's point at parameter t of each segment that has a point on either side."""
    w = Window.partitionBy(key).orderBy(*order)
    t2, t3 = t * t, t * t * t
    weights = (-tao * t + 2 * tao * t2 - tao * t3, 1 + (tao - 3) * t2 + (2 - tao) * t3, tao * t + (3 - 2 * tao) * t2 + (tao - 2) * t3, -tao * t2 + tao * t3)
    taps = lambda c: (F.lag(c).over(w), F.col(c), F.lead(c).over(w), F.lead(c, 2).over(w))
    out = points.withColumns({f"s{c}": sum((a * b for a, b in zip(weights, taps(c), strict=True)), F.lit(0.0)) for c in coordinates})
    return out.where(F.col(f"s{coordinates[0]}").isNotNull())


def derivative(points: DataFrame, key: str, coordinates: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Central difference along the line, one-sided at its ends."""
    w = Window.partitionBy(key).orderBy(*order)
    before, after = (lambda c: F.coalesce(F.lag(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lead(c).over(w), F.col(c)))
    return points.withColumns({f"d{c}": after(c) - before(c) for c in coordinates})
