"""Label assignments, classification and regrouping of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HUMAN, MACHINE
from .spatial_join import k_nearest


def best_label(assignments: DataFrame, key: tuple[str, ...] = ("object_id", "originator")) -> DataFrame:
    """The most confident assignment of each object and originator; of equals the first by place."""
    best = assignments.groupBy(*key).agg(F.max_by(F.struct("label", "confidence", "place"), F.struct("confidence", -F.col("place"))).alias("b"))
    return best.select(*key, "b.label", "b.confidence")


def current_label(assignments: DataFrame) -> DataFrame:
    """Human before machine, whatever the confidences; ground truth and others aren't consulted."""
    own = assignments.where(F.col("originator").isin(HUMAN, MACHINE))
    best = own.groupBy("object_id").agg(F.min_by(F.struct("label", "confidence", "originator"), F.struct("originator", -F.col("confidence"), "place")).alias("b"))
    return best.select("object_id", "b.label", "b.confidence", "b.originator")


def label_counts(assignments: DataFrame) -> DataFrame:
    return current_label(assignments).groupBy("label").agg(F.count("*").alias("objects"), F.avg("confidence").alias("confidence"))


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(predicted, truth, objects); objects without a prediction have a null one."""
    t = truth.select("object_id", F.col("label").alias("truth"))
    return t.join(predicted.select("object_id", F.col("label").alias("predicted")), "object_id", "left").groupBy("predicted", "truth").agg(F.count("*").alias("objects"))


def classify_nearest(objects: DataFrame, features: tuple[str, ...], label: str = "label") -> DataFrame:
    """Labels of unlabelled objects by their nearest labelled one; confidence 1 - 2 d1 / (d1 + d2) of squared distances, d2 to the nearest of another label.

    objects: object_id, features (two or three), label (null: unlabelled). Two bucketed nearest-neighbour joins, the
    second with the label found as a condition; no pair outside neighbouring cells is formed."""
    rows = objects.select("object_id", *features, F.col(label).alias("label"))
    train, asked = rows.where("label is not null"), rows.where("label is null").withColumn("label", F.lit(""))
    first = k_nearest(asked, train, 1, "object_id", carry=("label",), axes=features).select(F.col("query_id").alias("object_id"), F.col("plabel").alias("label"), F.col("distance").alias("d1"))
    again = asked.drop("label").join(first.select("object_id", "label"), "object_id")
    other = F.col("qlabel") != F.col("plabel")
    second = k_nearest(again, train, 1, "object_id", carry=("label",), residual=other, axes=features).select(F.col("query_id").alias("object_id"), F.col("distance").alias("d2"))
    near, far = F.col("d1") * F.col("d1"), F.col("d2") * F.col("d2")
    sure = F.coalesce(1 - F.try_divide(2 * near, near + far), F.lit(1.0))
    return first.join(second, "object_id", "left").select("object_id", "label", sure.alias("confidence"))


def regroup(points: DataFrame, instances: DataFrame) -> DataFrame:
    """Points with the object that an instance table (surfel_id, label_id, instance_id) gives them; others keep theirs."""
    own = instances.select("surfel_id", F.col("instance_id").alias("_to")).dropDuplicates(["surfel_id"])
    return points.join(own, "surfel_id", "left").withColumn("object_id", F.coalesce("_to", "object_id")).drop("_to")


def merge_object(points: DataFrame, source: int, target: int) -> DataFrame:
    return points.withColumn("object_id", F.when(F.col("object_id") == source, target).otherwise(F.col("object_id")))


def split_object(points: DataFrame, object_id: int, test: F.Column, a: int, b: int) -> DataFrame:
    """Rows of the object that pass go to a, the rest to b; unchanged if either side is empty."""
    sides = points.where(F.col("object_id") == object_id).agg(F.count_if(test).alias("yes"), F.count_if(~test).alias("no"))
    both = (F.col("yes") > 0) & (F.col("no") > 0)
    to = F.when(both & (F.col("object_id") == object_id), F.when(test, a).otherwise(b)).otherwise(F.col("object_id"))
    return points.crossJoin(F.broadcast(sides)).withColumn("object_id", to).drop("yes", "no")


def order_identifiers(points: DataFrame, parts: int | None = None) -> DataFrame:
    """surfel_id renumbered 1..N in block order, then by old id: a range exchange and offsets, not one global window."""
    ranged = points.repartitionByRange(*([parts] if parts else []), "block_id", "surfel_id").sortWithinPartitions("block_id", "surfel_id")
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).persist()
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.join(F.broadcast(before), "_part").withColumn("new_id", (F.col("_before") + own).cast("long")).drop("_part", "_at", "_before")
