"""A bitmap of hashed identifiers: a fixed number of bits, so it can be broadcast whatever the number of rows.

It lets a table be thinned before a join, so that rows that can't match aren't shuffled. With more identifiers than
bits it lets more rows through; the join after it decides all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, mix

#: 2^24 bits are 2 MB.
BITS = 24


def _place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _place(batch.column(0).drop_null().to_numpy())
        word, bit = at >> 6, np.left_shift(np.int64(1), at & 63)
        order = np.argsort(word, kind="stable")
        word, first = np.unique(word[order], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(bit[order], first) if len(word) else bit)], ["word", "bits"])


def thinned(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among ids (one column): all that are, and few others."""
    found = ids.mapInArrow(_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ids_of(batch, column)
            at = _place(own.fill_null(0).to_numpy())
            there = (shared.value[at >> 6] >> (at & 63)) & 1 == 1
            yield batch.filter(pa.array(there & own.is_valid().to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(run, rows.schema)
