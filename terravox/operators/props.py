"""Per-vertex properties: named double columns keyed by vertex_id; NULL is unknown."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "vertex_id"


def stats(props: DataFrame, column: str) -> DataFrame:
    """Over known values; the L1 norm is the sum of absolute values here."""
    v = F.col(column)
    return props.agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.stddev_pop(v).alias("stddev"), F.var_pop(v).alias("variance"),
        F.coalesce(F.sum(F.abs(v)), F.lit(0.0)).alias("l1"), F.coalesce(F.sqrt(F.sum(v * v)), F.lit(0.0)).alias("l2"), F.count_if(v != 0).alias("nonzero"),
    )


def percentile(props: DataFrame, column: str, p: float, alias: str = "value") -> DataFrame:
    """sorted known [min(n - 1, trunc(n p / 100))], p from 0 to 100; one row.

    Equal values are counted first; the running total is over one row for each distinct value, in a range exchange of
    the value where there are many (see rank_counts)."""
    counts = rank_counts(props, column)
    total = F.col("total")
    place = F.least((total * p / 100).cast("long"), total - 1)
    return counts.where((F.col("before") + F.col("n") > place) & (F.col("before") <= place)).select(F.col(column).alias(alias))


def rank_counts(props: DataFrame, column: str, key: Sequence[str] = ()) -> DataFrame:
    """(value, n, before, total): how often each known value stands there and how many are smaller.

    Without a key a window would put every value into one task. Values go through a range exchange instead; each
    partition's total is one row, the running sum of those is small, and the window runs inside partitions."""
    counts = props.where(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count("*").alias("n"))
    if key:
        w = Window.partitionBy(*key).orderBy(column)
        return counts.withColumns({"before": F.sum("n").over(w) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(*key))})
    ranged = counts.repartitionByRange(column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id()).persist()
    totals = ranged.groupBy("part").agg(F.sum("n").alias("own"))
    small = totals.withColumns({"ahead": F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("own").over(Window.partitionBy(F.lit(1)))})
    inside = Window.partitionBy("part").orderBy(column)
    return ranged.join(F.broadcast(small.drop("own")), "part").select(column, "n", (F.col("ahead") + F.sum("n").over(inside) - F.col("n")).alias("before"), "total")


def percentilize(props: DataFrame, column: str) -> DataFrame:
    """100 (rank - 1) / number of vertices, unknown ones counted too; equal values in order of vertex_id."""
    counts = rank_counts(props, column)
    many = props.agg(F.count("*").alias("vertices"))
    among = F.row_number().over(Window.partitionBy(column).orderBy(KEY)) - 1
    ranked = props.join(counts.select(column, "before"), column).withColumn("rank", F.col("before") + among)
    ranked = ranked.crossJoin(F.broadcast(many)).select(KEY, (100.0 * F.col("rank") / F.col("vertices")).alias("rank"))
    return props.join(ranked, KEY, "left").withColumn(column, F.col("rank")).drop("rank")


def normalize(props: DataFrame, column: str) -> DataFrame:
    """(v - mean) / population standard deviation, all 0 if that is 0."""
    one = props.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
    v = F.when(F.col(column).isNotNull(), F.when(F.col("s") > 0, F.try_divide(F.col(column) - F.col("m"), F.col("s"))).otherwise(F.lit(0.0)))
    return props.crossJoin(F.broadcast(one)).withColumn(column, v).drop("m", "s")


def entropy(props: DataFrame, column: str, bins: int = 50, compatible: bool = False) -> DataFrame:
    """log2 entropy of a linearly splatted histogram between the 1st and 99th percentile.

    Empty bins add nothing; compatible=True gives NaN if there is one, as 0 log 0 would."""
    ends = percentile(props, column, 1, "p1").crossJoin(percentile(props, column, 99, "p99"))
    at = F.greatest(F.lit(0.0), F.least(F.lit(bins - 1.0), F.try_divide((F.col(column) - F.col("p1")) * (bins - 1), F.col("p99") - F.col("p1"))))
    own = props.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).select(F.coalesce(at, F.lit(0.0)).alias("at"))
    low, part = F.floor("at"), F.col("at") - F.floor("at")
    votes = own.select(F.explode(F.array(F.struct(low.alias("bin"), (1 - part).alias("w")), F.struct(F.least(low + 1, F.lit(bins - 1)).alias("bin"), part.alias("w")))).alias("e"))
    hist = votes.where("e.w > 0").groupBy("e.bin").agg(F.sum("e.w").alias("w"))
    share = F.col("w") / F.col("all")
    total = hist.withColumn("all", F.sum("w").over(Window.partitionBy(F.lit(1))))  # at most `bins` rows
    out = total.agg(F.coalesce(-F.sum(share * F.log2(share)), F.lit(0.0)).alias("entropy"), F.count("*").alias("used"))
    return out.select(F.when(F.lit(compatible) & (F.col("used") < bins), F.lit(float("nan"))).otherwise(F.col("entropy")).alias("entropy"))


def _known(column: str, value: F.Column) -> F.Column:
    return F.when(F.col(column).isNotNull(), value)


def threshold(props: DataFrame, column: str, at: float, low: float | None, high: float | None) -> DataFrame:
    keep = lambda x: F.col(column) if x is None else F.lit(float(x))
    return props.withColumn(column, F.when(F.col(column) <= at, keep(low)).when(F.col(column) > at, keep(high)))


def mask(props: DataFrame, column: str, by: str) -> DataFrame:
    """0 where the mask is 0; unknown where either is unknown."""
    return props.withColumn(column, _known(by, F.when(F.col(by) == 0, _known(column, F.lit(0.0))).otherwise(F.col(column))))


def arithmetic(props: DataFrame, column: str, op: str, by: str | float) -> DataFrame:
    """add, subtract, multiply, divide (kept where the divisor is 0 or unknown), pow (kept where the exponent is 0)."""
    a, b = F.col(column), F.col(by) if isinstance(by, str) else F.lit(float(by))
    value = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": F.when(b.isNotNull() & (b != 0), F.try_divide(a, b)).otherwise(a), "pow": F.when(b != 0, F.pow(a, b)).otherwise(a)}[op]
    return props.withColumn(column, value)


UNARY = {"abs": F.abs, "sqrt": F.sqrt, "square": lambda c: c * c, "negate": lambda c: -c, "invert": lambda c: F.when(c != 0, F.try_divide(F.lit(1.0), c)).otherwise(c)}


def unary(props: DataFrame, column: str, op: str) -> DataFrame:
    return props.withColumn(column, UNARY[op](F.col(column)))


def substitute(props: DataFrame, column: str, old: float | None, new: float | None) -> DataFrame:
    return props.withColumn(column, F.when(F.col(column).eqNullSafe(F.lit(old)), F.lit(new)).otherwise(F.col(column)))


def dot(props: DataFrame, a: str, b: str) -> DataFrame:
    return props.agg(F.sum(F.col(a) * F.col(b)).alias("dot"))


def select(props: DataFrame, *columns: str) -> DataFrame:
    return props.select(KEY, *columns)


def rename(props: DataFrame, old: str, new: str) -> DataFrame:
    if new in props.columns:
        raise ValueError(f"{new} is there already")
    return props.withColumnRenamed(old, new)


def insert(props: DataFrame, name: str, value: F.Column) -> DataFrame:
    if name in props.columns:
        raise ValueError(f"{name} is there already")
    return props.withColumn(name, value)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of b next to those of a; names that both have get a number."""
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"{c}_2") if c in a.columns and c != KEY else d, b.columns, b)
    return a.join(renamed, KEY, "left")


def local_extrema(props: DataFrame, column: str, edges: DataFrame, maxima: bool) -> DataFrame:
    """Vertices whose value is strictly beyond that of every known neighbour. edges: (v0, v1) in both directions."""
    own = props.select(KEY, F.col(column).alias("v")).where("v is not null")
    other = own.select(F.col(KEY).alias("v1"), F.col("v").alias("u"))
    around = edges.join(other, "v1").groupBy("v0").agg((F.max if maxima else F.min)("u").alias("best"))
    near = own.join(around, own[KEY] == around["v0"], "left")
    beyond = F.col("v") > F.col("best") if maxima else F.col("v") < F.col("best")
    return near.where(F.col("best").isNull() | beyond).select(KEY, F.col("v").alias(column))


def laplacian(props: DataFrame, column: str, edges: DataFrame) -> DataFrame:
    """Value minus the weighted mean of known neighbours, 0 without weight. edges: (v0, v1, weight) in both directions."""
    other = props.select(F.col(KEY).alias("v1"), F.col(column).alias("u")).where("u is not null")
    mean = edges.join(other, "v1").groupBy("v0").agg(F.sum(F.col("weight") * F.col("u")).alias("s"), F.sum("weight").alias("w"))
    found = props.select(KEY, column).join(mean, F.col(KEY) == F.col("v0"), "left")
    value = F.when(F.coalesce(F.col("w"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col(column) - F.try_divide(F.col("s"), F.col("w")))
    return found.select(KEY, _known(column, value).alias(column))


def blur(props: DataFrame, column: str, distances: DataFrame, sigma: float) -> DataFrame:
    """Gaussian over graph distances up to 3 sigma, over known values. distances: (v0, v1, distance), a vertex and itself included."""
    other = props.select(F.col(KEY).alias("v1"), F.col(column).alias("u")).where("u is not null")
    w = F.exp(-F.col("distance") * F.col("distance") / F.lit(2 * sigma * sigma))
    near = distances.where(F.col("distance") <= 3 * sigma).join(other, "v1").groupBy("v0").agg(F.try_divide(F.sum(w * F.col("u")), F.sum(w)).alias("b"))
    return props.select(KEY, column).join(near, F.col(KEY) == F.col("v0"), "left").select(KEY, _known(column, F.col("b")).alias(column))
