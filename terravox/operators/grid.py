"""Rasters as cell tables: (grid_id, ix, iy[, iz], value).

Two rasters differ in rules, as their sources do: 2D values may be unknown (NULL) and unknown spreads; 3D values are
always known. Cell-wise operations are projections, pairs of grids meet in an equi-join on the cell, neighbourhoods
are an explode of offsets and an aggregation, or an ordered window along an axis. A grid's resolution is passed in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import exp

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GRID_ZERO, INFINITY
from .masks import LAPLACE2, LAPLACE3, SOBEL_X, SOBEL_Y  # noqa: F401

V = F.col("value")
CELL2, CELL3 = ["grid_id", "ix", "iy"], ["grid_id", "ix", "iy", "iz"]


def cell_of(df: DataFrame) -> list[str]:
    return CELL3 if "iz" in df.columns else CELL2


def axes_of(df: DataFrame) -> list[str]:
    return cell_of(df)[1:]


# cell by cell
UNARY = {
    "abs": F.abs(V), "sqrt": F.sqrt(V), "square": V * V, "negate": -V,
    "invert": F.when(F.abs(V) > GRID_ZERO, F.try_divide(F.lit(1.0), V)).otherwise(V),
}


def apply(cells: DataFrame, value: F.Column) -> DataFrame:
    return cells.withColumn("value", value)


def unary(cells: DataFrame, name: str) -> DataFrame:
    return apply(cells, UNARY[name])


def power(cells: DataFrame, e: float) -> DataFrame:
    """3D: of the absolute value; 2D: of the value as it is (a negative base with a fractional exponent gives NaN)."""
    return apply(cells, F.pow(F.abs(V) if "iz" in cells.columns else V, F.lit(e)))


def threshold(cells: DataFrame, at: float, low: float | None, high: float | None) -> DataFrame:
    """value <= at: low, else high; None keeps the value. Unknown stays unknown."""
    keep = lambda x: V if x is None else F.lit(float(x))
    return apply(cells, F.when(V <= at, keep(low)).when(V > at, keep(high)))


def substitute(cells: DataFrame, old: float | None, new: float | None) -> DataFrame:
    return apply(cells, F.when(V.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(V))


def reflect(cells: DataFrame, resolution: Sequence[int]) -> DataFrame:
    """Through the grid's middle: every index turns round."""
    return cells.withColumns({a: F.lit(n - 1) - F.col(a) for a, n in zip(axes_of(cells), resolution, strict=True)})


def linear_index(cells: DataFrame, resolution: Sequence[int]) -> F.Column:
    """(z * Y + y) * X + x"""
    return reduce(lambda acc, an: acc * an[1] + F.col(an[0]), list(zip(axes_of(cells), resolution, strict=True))[::-1], F.lit(0))


def pairwise(a: DataFrame, b: DataFrame, value: F.Column) -> DataFrame:
    """Two grids of one resolution; the Column sees `value` and `other`. Cells that b lacks are unknown there."""
    key = cell_of(a)
    return a.join(b.select(*key, F.col("value").alias("other")), key, "left").withColumn("value", value).drop("other")


O = F.col("other")  # noqa: E741
PAIRWISE2 = {
    "add": V + O, "subtract": V - O, "multiply": V * O,
    "divide": F.when(O.isNull(), F.lit(None)).when(O != 0, F.try_divide(V, O)).when(V > 0, F.lit(INFINITY)).when(V < 0, F.lit(-INFINITY)).when(V == 0, V),
    "min": F.least(V, O), "max": F.greatest(V, O),
    "mask": F.when(V.isNull() | O.isNull(), F.lit(None)).when(O == 0, F.lit(0.0)).otherwise(V),
    "overlay": F.when(O.isNotNull() & (O != 0), O).otherwise(V),
}
PAIRWISE3 = PAIRWISE2 | {"divide": F.when(F.abs(O) > GRID_ZERO, F.try_divide(V, O)).otherwise(V), "mask": F.when(O == 0, F.lit(0.0)).otherwise(V)}


def combine(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return pairwise(a, b, (PAIRWISE3 if "iz" in a.columns else PAIRWISE2)[name])


def divide_by(cells: DataFrame, k: float) -> DataFrame:
    return cells if abs(k) < GRID_ZERO else apply(cells, V / k)


def quotient(a: F.Column, b: F.Column) -> F.Column:
    """a / b of doubles with SQL's results by zero, of either sign: infinite, or not a number for 0 / 0."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when((b == 0) & a.isNotNull(), by_zero).otherwise(F.try_divide(a, b))


def quantise(cells: DataFrame, n: int) -> DataFrame:
    """Equal-width levels 0..n-1 between the least and the largest value; unchanged if those are equal."""
    ends = cells.groupBy("grid_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # a row a grid
    level = F.least(F.lit(n - 1), F.try_divide(n * (V - F.col("lo")), F.col("hi") - F.col("lo")).cast("int")).cast("double")
    return cells.join(F.broadcast(ends), "grid_id").withColumn("value", F.when(F.col("hi") > F.col("lo"), level).otherwise(V)).drop("lo", "hi")


def normalize(cells: DataFrame, divide: bool = False) -> DataFrame:
    """By the square root of the sum of squares; unchanged where that is zero. divide: by any, as SQL does (see quotient())."""
    norm = cells.groupBy("grid_id").agg(F.sqrt(F.sum(V * V)).alias("norm"))
    return cells.join(F.broadcast(norm), "grid_id").withColumn("value", quotient(V, F.col("norm")) if divide else F.when(F.col("norm") > 0, F.try_divide(V, F.col("norm"))).otherwise(V)).drop("norm")


def forward_difference(cells: DataFrame, axis: str) -> DataFrame:
    """Next minus this; unknown where either is zero or unknown, and in the last line."""
    others = [c for c in cell_of(cells) if c != axis]
    after = F.lead("value").over(Window.partitionBy(*others).orderBy(axis))
    return cells.withColumn("value", F.when((V != 0) & (after != 0), after - V))


# statistics
def stats(cells: DataFrame) -> DataFrame:
    """Over known cells; the L1 norm is the plain sum, the cardinality counts cells that aren't zero."""
    return cells.groupBy("grid_id").agg(
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("l1"),
        F.coalesce(F.sqrt(F.sum(V * V)), F.lit(0.0)).alias("l2"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("stddev"), F.count_if(V != 0).alias("cardinality"),
    )


def percentile(cells: DataFrame, p: float, key: Sequence[str] = ("grid_id",)) -> DataFrame:
    """sorted[trunc(p * n)] of the known values, the last one at p = 1; no interpolation.

    Values are counted before they are ranked, so the window sees one row for each distinct value of a grid."""
    counts = cells.where(V.isNotNull()).groupBy(*key, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy("value")
    whole = Window.partitionBy(*key)
    ranked = counts.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(whole)})
    place = F.least((F.col("total") * p).cast("long"), F.col("total") - 1)
    return ranked.where(F.col("upto") > place).groupBy(*key).agg(F.min("value").alias("value"))


def centroid(cells: DataFrame, divide: bool = False) -> DataFrame:
    """Value-weighted mean index; sums where the total isn't positive. divide: by any total, as SQL does (see quotient())."""
    total = F.sum("value")
    return cells.groupBy("grid_id").agg(*((quotient(F.sum(V * F.col(a)), total) if divide else F.when(total > 0, F.try_divide(F.sum(V * F.col(a)), total)).otherwise(F.sum(V * F.col(a)))).alias(f"c{a[1]}") for a in axes_of(cells)))


def covariance(cells: DataFrame) -> DataFrame:
    """Value-weighted second moments about the centroid, in one pass over sums."""
    axes = axes_of(cells)
    w = F.sum("value")
    mean = {a: F.sum(V * F.col(a)) / w for a in axes}
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return cells.groupBy("grid_id").agg(*((F.sum(V * F.col(a) * F.col(b)) / w - mean[a] * mean[b]).alias(f"m{a[1]}{b[1]}") for a, b in pairs))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner product, sum of absolute and of squared differences over cells known in both."""
    key = cell_of(a)
    both = a.join(b.select(*key, F.col("value").alias("other")), key)
    return both.groupBy("grid_id").agg(F.sum(V * O).alias("dot"), F.sum(F.abs(V - O)).alias("l1_distance"), F.sum((V - O) * (V - O)).alias("l2_distance_squared"))


# neighbourhoods
def neighbours(cells: DataFrame, offsets: Sequence[tuple], extra: Sequence[F.Column] = ()) -> DataFrame:
    """For each cell its values at offsets: rows (cell, k, tap) with k the offset's number. Cells give their value to those around."""
    axes = axes_of(cells)
    taps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(-d).alias(f"d{a}") for a, d in zip(axes, o, strict=True))) for k, o in enumerate(offsets))))
    given = cells.select("grid_id", *axes, V.alias("tap"), *extra, taps.alias("o"))
    return given.select("grid_id", *((F.col(a) + F.col(f"o.d{a}")).alias(a) for a in axes), "o.k", "tap", *[c for c in given.columns if c not in ("grid_id", *axes, "tap", "o")])


def convolve(cells: DataFrame, mask: Sequence[float], resolution: Sequence[int]) -> DataFrame:
    """A 3x3 or 3x3x3 correlation; mask runs x fastest. Borders are unknown in 2D and 0 in 3D; an unknown tap makes a 2D result unknown."""
    axes = axes_of(cells)
    d = len(axes)
    offsets = [tuple(reversed(o)) for o in product((-1, 0, 1), repeat=d)]
    weight = F.element_at(F.array(*(F.lit(float(m)) for m in mask)), F.col("k") + 1)
    got = neighbours(cells, offsets).where(F.col("tap").isNotNull()).groupBy(*cell_of(cells)).agg(F.sum(weight * F.col("tap")).alias("sum"), F.count("*").alias("taps"))
    inside = reduce(lambda a, b: a & b, ((F.col(a) > 0) & (F.col(a) < n - 1) for a, n in zip(axes, resolution, strict=True)))
    outside = F.lit(0.0) if d == 3 else F.lit(None).cast("double")
    out = cells.drop("value").join(got, cell_of(cells), "left")
    return out.withColumn("value", F.when(inside & (F.col("taps") == 3**d), F.col("sum")).otherwise(outside)).drop("sum", "taps")



def gradient(cells: DataFrame, axis: str, resolution: Sequence[int]) -> DataFrame:
    if "iz" not in cells.columns:
        return convolve(cells, SOBEL_X if axis == "ix" else SOBEL_Y, resolution)
    at = axes_of(cells).index(axis)
    # x fastest; the middle line of each face weighs twice a side line
    weights = [(o[2 - at]) * (2 if all(v == 0 for i, v in enumerate(o) if i != 2 - at) else 1) / 12 for o in product((-1, 0, 1), repeat=3)]
    return convolve(cells, weights, resolution)


def gradient_magnitude(cells: DataFrame, resolution: Sequence[int]) -> DataFrame:
    key = cell_of(cells)
    parts = [gradient(cells, a, resolution).select(*key, F.col("value").alias(f"g{a}")) for a in axes_of(cells)]
    out = reduce(lambda a, b: a.join(b, key), parts)
    return out.select(*key, F.sqrt(reduce(lambda a, b: a + b, (F.col(f"g{a}") * F.col(f"g{a}") for a in axes_of(cells)))).alias("value"))


def gradient_angle(cells: DataFrame, resolution: Sequence[int]) -> DataFrame:
    """atan(gy / gx); a right angle where gx is 0."""
    gx = gradient(cells, "ix", resolution).select(*CELL2, F.col("value").alias("gx"))
    gy = gradient(cells, "iy", resolution).select(*CELL2, F.col("value").alias("gy"))
    slope = F.when(F.col("gx") == 0, F.lit(1.5707963267948966)).otherwise(F.atan(F.try_divide(F.col("gy"), F.col("gx"))))
    return gx.join(gy, CELL2).select(*CELL2, F.when(F.col("gx").isNotNull() & F.col("gy").isNotNull(), slope).alias("value"))


def hessian(cells: DataFrame, first: str, second: str, resolution: Sequence[int]) -> DataFrame:
    return gradient(gradient(cells, first, resolution), second, resolution)


def blur_axis(cells: DataFrame, axis: str, sigma: float) -> DataFrame:
    """Gaussian along an axis with radius trunc(3 sigma + 0.5), renormalised over known cells; an unknown cell stays unknown."""
    radius = int(3 * sigma + 0.5)
    others = [c for c in cell_of(cells) if c != axis]
    w = Window.partitionBy(*others).orderBy(axis).rangeBetween(-radius, radius)
    near = F.collect_list(F.when(V.isNotNull(), F.struct(F.col(axis).alias("i"), V.alias("v")))).over(w)
    gauss = lambda e: F.exp(-((e["i"] - F.col(axis)) * (e["i"] - F.col(axis))) / F.lit(2.0 * sigma * sigma))
    top = F.aggregate(near, F.lit(0.0), lambda acc, e: acc + gauss(e) * e["v"])
    low = F.aggregate(near, F.lit(0.0), lambda acc, e: acc + gauss(e))
    return cells.withColumn("value", F.when(V.isNotNull() & (low > 0), F.try_divide(top, low)))


def blur(cells: DataFrame, sigma: float) -> DataFrame:
    return reduce(lambda c, a: blur_axis(c, a, sigma), axes_of(cells), cells)


def ball(d: int, radius: float) -> list[tuple]:
    r = int(radius)
    return [o for o in product(range(-r, r + 1), repeat=d) if sum(v * v for v in o) <= radius * radius]


def percentile_filter(cells: DataFrame, radius: int, p: float) -> DataFrame:
    """sorted[clamp(trunc(p * n))] of the known values in a disc or ball; unknown cells stay unknown."""
    key = cell_of(cells)
    got = neighbours(cells, ball(len(key) - 1, radius)).where(F.col("tap").isNotNull())
    if p in (0.0, 1.0):
        got = got.groupBy(*key).agg((F.min if p == 0 else F.max)("tap").alias("got"))
    else:  # at most as many taps as the ball has cells
        got = got.groupBy(*key).agg(F.sort_array(F.collect_list("tap")).alias("taps"))
        n = F.size("taps")
        got = got.select(*key, F.element_at("taps", F.least((n * p).cast("int"), n - 1) + 1).alias("got"))
    return cells.join(got, key, "left").withColumn("value", F.when(V.isNotNull(), F.col("got"))).drop("got")


def bilateral(cells: DataFrame, sigma: float, value_sigma: float) -> DataFrame:
    """Weights exp(-d2 / 2 s2) exp(-dv2 / 2 vs2) over a ball of radius trunc(3 sigma + 1)."""
    key = cell_of(cells)
    offsets = ball(len(key) - 1, int(3 * sigma + 1))
    near = F.element_at(F.array(*(F.lit(exp(-sum(v * v for v in o) / (2 * sigma * sigma))) for o in offsets)), F.col("k") + 1)
    got = neighbours(cells, offsets).join(cells.select(*key, "value"), key).where(F.col("tap").isNotNull() & V.isNotNull())
    weight = near * F.exp(-((F.col("tap") - V) * (F.col("tap") - V)) / F.lit(2 * value_sigma * value_sigma))
    got = got.groupBy(*key).agg((F.sum(weight * F.col("tap")) / F.sum(weight)).alias("got"))
    return cells.join(got, key, "left").withColumn("value", F.col("got")).drop("got")


def harris(cells: DataFrame, radius: int, kappa: float, resolution: Sequence[int]) -> DataFrame:
    """det - kappa trace^2 of the structure tensor, Gaussian-weighted over a square window; unknown gradients are left out."""
    gx = gradient(cells, "ix", resolution).select(*CELL2, F.col("value").alias("gx"))
    g = gx.join(gradient(cells, "iy", resolution).select(*CELL2, F.col("value").alias("gy")), CELL2)
    offsets = list(product(range(-radius, radius + 1), repeat=2))
    weight = F.element_at(F.array(*(F.lit(exp(-(a * a + b * b) / (radius * radius / 2))) for a, b in offsets)), F.col("k") + 1)
    got = neighbours(g.withColumn("value", F.lit(1.0)), offsets, [F.col("gx"), F.col("gy")]).where("gx is not null and gy is not null")
    s = lambda a, b: F.sum(weight * F.col(a) * F.col(b))
    got = got.groupBy(*CELL2).agg(s("gx", "gx").alias("xx"), s("gx", "gy").alias("xy"), s("gy", "gy").alias("yy"))
    value = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - kappa * (F.col("xx") + F.col("yy")) * (F.col("xx") + F.col("yy"))
    return cells.drop("value").join(got.select(*CELL2, value.alias("value")), CELL2, "left")


def mask_non_extrema(cells: DataFrame, radius: int, maxima: bool) -> DataFrame:
    """0 where a neighbour in the ball is larger (or smaller)."""
    key = cell_of(cells)
    best = percentile_filter(cells, radius, 1.0 if maxima else 0.0).select(*key, F.col("value").alias("best"))
    beaten = V < F.col("best") if maxima else V > F.col("best")
    return cells.join(best, key).withColumn("value", F.when(beaten, F.lit(0.0)).otherwise(V)).drop("best")


def fill_gaps(cells: DataFrame, axis: str, most: int) -> DataFrame:
    """Linear interpolation along an axis across runs of unknown cells shorter than `most`."""
    others = [c for c in cell_of(cells) if c != axis]
    w = Window.partitionBy(*others).orderBy(axis)
    at = F.when(V.isNotNull(), F.col(axis))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    found = cells.withColumns({"i1": F.last(at, True).over(before), "v1": F.last("value", True).over(before), "i2": F.first(at, True).over(after), "v2": F.first("value", True).over(after)})
    t = F.try_divide(F.col(axis) - F.col("i1"), F.col("i2") - F.col("i1"))
    filled = F.when(F.col("i2") - F.col("i1") - 1 < most, F.col("v1") + t * (F.col("v2") - F.col("v1")))
    return found.withColumn("value", F.coalesce(V, filled)).drop("i1", "i2", "v1", "v2")


# sampling and resampling
def _corners(points: DataFrame, at: Sequence[F.Column], names: Sequence[str]) -> DataFrame:
    """Each point with its 2^d corner cells and weights."""
    base = [F.floor(c).cast("int") for c in at]
    part = [c - F.floor(c) for c in at]
    corners = F.array(*(F.struct(*((base[i] + o[i]).alias(n) for i, n in enumerate(names)), reduce(lambda a, b: a * b, (part[i] if o[i] else 1 - part[i] for i in range(len(at)))).alias("w")) for o in product((0, 1), repeat=len(at))))
    return points.withColumn("corner", F.explode(corners))


def sample2(points: DataFrame, cells: DataFrame, x: F.Column, y: F.Column, name: str, ident: str = "surfel_id") -> DataFrame:
    """Bilinear value under each point over the known corners, their weights renormalised; unknown outside."""
    c = _corners(points.select(ident, x.alias("gx"), y.alias("gy")), [F.col("gx"), F.col("gy")], ["ix", "iy"]).select(ident, "corner.ix", "corner.iy", "corner.w")
    got = c.join(cells.where(V.isNotNull()).select("ix", "iy", "value"), ["ix", "iy"]).where("w > 0").groupBy(ident).agg(F.try_divide(F.sum(F.col("w") * V), F.sum("w")).alias(name))
    return points.join(got, ident, "left")


def sample3(points: DataFrame, cells: DataFrame, at: Sequence[F.Column], name: str, ident: str = "surfel_id") -> DataFrame:
    """Trilinear value; corners outside the grid count as 0."""
    own = points.select(ident, *(c.alias(f"g{i}") for i, c in enumerate(at)))
    c = _corners(own, [F.col(f"g{i}") for i in range(3)], ["ix", "iy", "iz"]).select(ident, "corner.ix", "corner.iy", "corner.iz", "corner.w")
    got = c.join(cells.select("ix", "iy", "iz", "value"), ["ix", "iy", "iz"], "left").groupBy(ident).agg(F.sum(F.col("w") * F.coalesce(V, F.lit(0.0))).alias(name))
    return points.join(got, ident, "left")


def resample2(cells: DataFrame, old: Sequence[int], new: Sequence[int]) -> DataFrame:
    """Bilinear at i * (old - 1) / (new - 1)."""
    spark = cells.sparkSession
    target = spark.range(new[0]).select(F.col("id").cast("int").alias("jx"), F.explode(F.sequence(F.lit(0), F.lit(new[1] - 1))).alias("jy"))
    target = target.crossJoin(cells.select("grid_id").distinct()).withColumn("cell", F.struct("grid_id", "jx", "jy"))
    scale = lambda c, o, n: F.col(c) * ((o - 1) / max(n - 1, 1))
    got = sample2(target, cells, scale("jx", old[0], new[0]), scale("jy", old[1], new[1]), "value", "cell")
    return got.select("grid_id", F.col("jx").alias("ix"), F.col("jy").alias("iy"), "value")


def pad(cells: DataFrame, resolution: Sequence[int], by: int) -> DataFrame:
    """A border of zeros; old cells move by its width."""
    spark = cells.sparkSession
    axes = axes_of(cells)
    target = spark.range(resolution[0] + 2 * by).select(F.col("id").cast("int").alias(axes[0]))
    for a, n in list(zip(axes, resolution, strict=True))[1:]:
        target = target.select("*", F.explode(F.sequence(F.lit(0), F.lit(n + 2 * by - 1))).alias(a))
    target = target.crossJoin(cells.select("grid_id").distinct())
    moved = cells.withColumns({a: F.col(a) + by for a in axes})
    inside = reduce(lambda a, b: a & b, (F.col(a).between(by, by + n - 1) for a, n in zip(axes, resolution, strict=True)))
    return target.join(moved, cell_of(cells), "left").select(*cell_of(cells), F.when(inside, V).otherwise(F.lit(0.0)).alias("value"))


# rasterization
def splat(points: DataFrame, at: Sequence[F.Column], weight: F.Column, resolution: Sequence[int]) -> DataFrame:
    """Each point's weight on its 2^d corner cells; points outside [0, resolution - 1] are dropped. Partial sums before the shuffle."""
    names = ["ix", "iy", "iz"][: len(at)]
    own = points.select(weight.alias("amount"), *(c.alias(f"g{i}") for i, c in enumerate(at)))
    inside = reduce(lambda a, b: a & b, (F.col(f"g{i}").between(0, n - 1) for i, n in enumerate(resolution)))
    c = _corners(own.where(inside), [F.col(f"g{i}") for i in range(len(at))], names).select(*(F.col(f"corner.{n}").alias(n) for n in names), (F.col("corner.w") * F.col("amount")).alias("v"))
    return c.where("v <> 0").groupBy(*names).agg(F.sum("v").alias("value"))


def shape(spark, resolution: Sequence[int], inside: F.Column) -> DataFrame:
    """Cells of a grid whose index satisfies a test (box, circle, sphere, plane, polygon)."""
    names = ["ix", "iy", "iz"][: len(resolution)]
    out = spark.range(resolution[0]).select(F.col("id").cast("int").alias("ix"))
    for a, n in list(zip(names, resolution, strict=True))[1:]:
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(a))
    return out.where(inside).withColumn("value", F.lit(1.0))


def span(segments: DataFrame, ends: Sequence[tuple[F.Column, F.Column]]) -> DataFrame:
    """Cells of straight segments: one step along the longest axis at a time, the others rounded."""
    names = ["ix", "iy", "iz"][: len(ends)]
    steps = F.greatest(*(F.abs(b - a) for a, b in ends))
    n = F.ceil(steps).cast("int")
    i = F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0))))
    rows = segments.select(*(a.alias(f"a{k}") for k, (a, _) in enumerate(ends)), *(b.alias(f"b{k}") for k, (_, b) in enumerate(ends)), n.alias("n"), i.alias("i"))
    t = F.coalesce(F.try_divide(F.col("i"), F.col("n")), F.lit(0.0))
    cell = [(F.col(f"a{k}") + t * (F.col(f"b{k}") - F.col(f"a{k}")) + 0.5).cast("int").alias(names[k]) for k in range(len(ends))]
    return rows.select(*cell).groupBy(*names).agg(F.count("*").cast("double").alias("value"))
