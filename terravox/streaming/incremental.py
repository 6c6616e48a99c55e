"""Structured Streaming counterparts of the update hooks: current labels and block statistics kept as rows arrive.

The batch operators are functions of DataFrames, so projections, scans and splats run on streams as they are. What
keeps state across micro-batches is here: each batch is merged into a Parquet table under a new version, and the
version's number is the batch's, so a batch that is run again after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import current_label
from ..operators.predicates import block_stats


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{version}/_SUCCESS")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(f"{folder}/{version}") if there else None


def keep_labels(assignments: DataFrame, folder: str, checkpoint: str):
    """Start a stream of assignments (object_id, label, place, originator, confidence) into the current label of each object."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = lambda df: df.select("object_id", "label", "confidence", "originator", "place")
        before = read_version(spark, folder, number - 1)
        both = best(batch) if before is None else best(batch).unionByName(before)
        # a batch keeps one row for each object and originator, which is all that a later choice can depend on
        kept = both.groupBy("object_id", "originator").agg(F.max_by(F.struct("label", "confidence", "place"), F.struct("confidence", -F.col("place"))).alias("b"))
        kept.select("object_id", "originator", "b.*").write.mode("overwrite").parquet(f"{folder}/{number}")

    return assignments.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def labels_at(spark: SparkSession, folder: str, version: int) -> DataFrame:
    kept = read_version(spark, folder, version)
    if kept is None:
        raise ValueError(f"no version {version} in {folder}")
    return current_label(kept)


def keep_block_stats(points: DataFrame, folder: str, checkpoint: str):
    """Start a stream of surfels into the statistics of their blocks; extents and ranges merge, they are never recomputed."""

    def merge(batch: DataFrame, number: int) -> None:
        new = block_stats(batch).drop("resolution")
        before = read_version(batch.sparkSession, folder, number - 1)
        both = new if before is None else new.unionByName(before)
        how = {"n": F.sum, "flags": F.bit_or} | {c: F.min for c in ("xmin", "ymin", "zmin", "tmin", "min_id")} | {c: F.max for c in ("xmax", "ymax", "zmax", "tmax", "max_id")}
        both.groupBy("block_id").agg(*(f(c).alias(c) for c, f in how.items())).write.mode("overwrite").parquet(f"{folder}/{number}")

    return points.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_density(points: DataFrame, time: str, window: str, late: str, cell: float) -> DataFrame:
    """Points and mean height in each ground cell and time window of a stream, with a watermark for late rows."""
    at = [F.floor(F.col(a) / cell).cast("long").alias(f"i{a}") for a in "xy"]
    return points.withWatermark(time, late).groupBy(F.window(time, window), *at).agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"))
