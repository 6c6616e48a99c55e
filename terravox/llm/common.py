"""What the corpus operators share: the shared folder, cut lineage, Arrow text buffers and hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups that may be broadcast because they are large: there are fewer than HOT with more than one HOT-th of all rows.
HOT = 1_000

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine (tests)."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="terravox-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if the session still runs."""
    jsc = spark.sparkContext._jsc
    if jsc is None or spark.sparkContext._jvm is None or jsc.sc().isStopped():
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. A lost executor costs nothing that is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._terravox_path = path  # for an early drop()
    return back


def drop(df: DataFrame) -> None:
    """Remove what written() made, once nothing reads it any more."""
    remove(df.sparkSession, df._terravox_path)


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], members: str, total: int, salt: F.Column, lonely: F.Column | None = None) -> DataFrame:
    """rows left join groups (one row a key, with its number of members) without a task for any one large group.

    Fewer than HOT groups can have more than total / HOT members: these are broadcast, whatever the size of the tables.
    Rows that meet one are dealt by `salt` in the shuffle join with the other groups, which have total / HOT members at
    most. `lonely` rows are known to meet no group and are dealt by `salt` too. Null keys match nothing."""
    own = [c for c in groups.columns if c not in key]
    large = groups.where(F.col(members) * HOT > total).select(*key, F.lit(True).alias("_large"), *(F.col(c).alias(f"_{c}") for c in own))
    small = groups.where(F.col(members) * HOT <= total).withColumn("_salt", F.lit(0))
    spread = F.coalesce("_large", F.lit(False)) if lonely is None else F.coalesce("_large", lonely)
    met = rows.join(F.broadcast(large), key, "left").withColumn("_salt", F.when(spread, 1 + F.pmod(salt, F.lit(HOT))).otherwise(0).cast("int"))
    both = met.join(small, [*key, "_salt"], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in own})
    return both.select(*rows.columns, *own)


def texts(column: pa.Array) -> pa.Array:
    """A string column as large strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str = "text", at_most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text each (or a single longer text), so that numpy temporaries stay small."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.concatenate([[0], np.cumsum(size)]), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, total[start] + at_most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, null as empty, and the offsets of its rows in them."""
    column = texts(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] else np.zeros(0, np.uint8)), at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
