"""Images as aggregations: project, then keep the nearest of each pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overhead(points: DataFrame, scale: float, x0: float, y0: float, width: int, height: int, ident: str = "surfel_id") -> DataFrame:
    """(ix, iy, id, z, n): the highest point of each pixel from above, ties to the smaller id."""
    own = points.select(ident, "z", ((F.col("x") - x0) * scale + 0.5).cast("int").alias("ix"), ((F.col("y") - y0) * scale + 0.5).cast("int").alias("iy"))
    own = own.where(F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1))
    return own.groupBy("ix", "iy").agg(F.max_by(ident, F.struct("z", -F.col(ident))).alias(ident), F.max("z").alias("z"), F.count("*").alias("n"))


def pinhole(points: DataFrame, fx: float, fy: float, cx: float, cy: float, width: int, height: int, ident: str = "surfel_id") -> DataFrame:
    """(ix, iy, id, depth) of a camera at the origin that looks along -z: the nearest point of each pixel."""
    depth = -F.col("z")
    own = points.select(ident, depth.alias("depth"), (F.try_divide(F.col("x") * fx, depth) + cx + 0.5).cast("int").alias("ix"), (F.try_divide(F.col("y") * fy, depth) + cy + 0.5).cast("int").alias("iy"))
    own = own.where((F.col("depth") > 0) & F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1))
    return own.groupBy("ix", "iy").agg(F.min_by(ident, F.struct("depth", ident)).alias(ident), F.min("depth").alias("depth"))


def unproject(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    d = F.col("depth")
    return pixels.withColumns({"x": (F.col("ix") - cx) * d / fx, "y": (F.col("iy") - cy) * d / fy, "z": -d})


def label_boundaries(pixels: DataFrame, label: str) -> DataFrame:
    """1 where a neighbour right or above has another label."""
    r = F.lead(label).over(Window.partitionBy("iy").orderBy("ix"))
    u = F.lead(label).over(Window.partitionBy("ix").orderBy("iy"))
    return pixels.withColumn("boundary", (F.coalesce(r != F.col(label), F.lit(False)) | F.coalesce(u != F.col(label), F.lit(False))).cast("int"))


def coverage_score(pixels: DataFrame, label: str, least: int, most_needed: int) -> DataFrame:
    """Sum of log(pixels div least) over labels with at least `least` pixels; 0 unless more than `most_needed` are seen."""
    seen = pixels.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = seen.agg(F.sum(F.log(F.floor(F.col("n") / least).cast("double"))).alias("score"), F.count("*").alias("labels"))
    return total.select(F.when(F.col("labels") > most_needed, F.col("score")).otherwise(F.lit(0.0)).alias("score"), "labels")


def weighted_color(points: DataFrame, images: DataFrame, channels: Sequence[str], ident: str = "surfel_id") -> DataFrame:
    """Mean colour of each point over the images in front of it, weighted by n.v / depth; grey where none sees it.

    images: image_id, ex, ey, ez and the channels; a catalog with a row an image."""
    d = [F.col(f"e{a}") - F.col(a) for a in "xyz"]
    dist = F.sqrt(sum((c * c for c in d), F.lit(0.0)))
    facing = F.try_divide(sum((c * F.col(f"n{a}") for c, a in zip(d, "xyz", strict=True)), F.lit(0.0)), dist)
    w = F.try_divide(facing, dist)
    # every point meets every image, in blocks that both sides name: one block is a row of some numbers for each of 50,000 images
    blocks = max(1, -(-images.count() // 50_000))
    side = images.withColumn("_block", F.pmod(F.xxhash64("image_id"), F.lit(blocks)))
    dealt = points.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    met = dealt.join(F.broadcast(side) if blocks == 1 else side, "_block").where(facing > 0)
    seen = met.groupBy(ident).agg(*((F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in channels))
    return points.select(ident).join(seen, ident, "left").select(ident, *(F.coalesce(c, F.lit(0.5)).alias(c) for c in channels))
