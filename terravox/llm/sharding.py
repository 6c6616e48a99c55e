"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in one global order: by the smallest doc_id of the rows with the same text, then doc_id, so equal texts
are neighbours. A range exchange gives each partition a stretch of that order; its total is one row; the running sum
of those totals (one row a partition) gives each partition its offset, and a window inside the partition gives each
row the bytes before it. Cuts lie at equal targets. A cut inside a group of equal texts moves to the group's nearer
edge if that costs less than `tolerance` of a shard; larger groups are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, written


def byte_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, rows_per_partition: int = 500_000) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1 (a null text has none). Shards 0..n-1 are contiguous in the order
    above, slot counts from 0 without gaps in each, law is `bytes` and grown_shard null. Repeated rows each get a
    slot of their own, rows without a doc_id come first; an empty table gives no rows. With fewer rows than shards,
    some shards stay empty. Texts may be of any length; other columns are ignored, whatever their names.
    """
    own = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )
    own = written(own, "shard-rows")
    key = ["text_hash", "text_crc32", "size"]
    groups = own.groupBy(*key).agg(F.min("doc_id").alias("owner"), F.count("*").alias("members"))
    shared = groups.where("members > 1").select(*key, F.col("owner").alias("group_owner"), "members")
    total = own.count()
    keyed = join_groups(own, shared, key, "members", total, F.xxhash64("doc_id"))
    keyed = keyed.select("doc_id", "size", "text_crc32", F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("group_owner")).alias("owner"))
    parts = max(1, -(-total // rows_per_partition))
    ordered = keyed.repartitionByRange(parts, F.col("owner").asc_nulls_first(), F.col("doc_id").asc_nulls_first())
    # the partition number and place are fixed here once; every later pass reads them from the shared folder
    placed = ordered.sortWithinPartitions(F.col("owner").asc_nulls_first(), F.col("doc_id").asc_nulls_first())
    placed = written(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "shard-order")

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    zero = F.lit(0).cast("long")
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), zero).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), zero).alias("rows_before"), F.sum("bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy("place")
    rows = placed.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", "owner", "all_bytes",
        (F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"),
    )
    target = F.col("all_bytes") / F.lit(float(shards))
    by_row = F.least(F.lit(shards - 1), F.floor((F.col("start") + F.col("size") / 2) / target)).cast("int")
    rows = rows.withColumn("own_shard", by_row)
    # groups that a cut goes through: at most one a cut, so their table has fewer rows than there are shards
    spans = rows.groupBy("owner").agg(F.min("own_shard").alias("first_shard"), F.max("own_shard").alias("last_shard"), F.min("start").alias("group_start"), F.max(F.col("start") + F.col("size")).alias("group_end"), F.max("all_bytes").alias("total"))
    middle = F.least(F.lit(shards - 1), F.floor((F.col("group_start") + F.col("group_end")) / 2 / (F.col("total") / F.lit(float(shards))))).cast("int")
    cut = spans.where((F.col("first_shard") < F.col("last_shard")) & (F.col("group_end") - F.col("group_start") <= F.col("total") / shards * tolerance)).select("owner", middle.alias("moved_shard")).limit(shards)
    whole = rows.join(F.broadcast(cut), rows["owner"].eqNullSafe(cut["owner"]), "left").select("doc_id", "size", "text_crc32", "row", F.coalesce("moved_shard", "own_shard").alias("shard"))
    whole = written(whole, "shard-cuts")
    firsts = whole.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return whole.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
