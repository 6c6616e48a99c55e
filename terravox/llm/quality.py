"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's terms are hashed byte trigrams, pairs of character classes and repetition events of its whole text. A
bounded sample of labelled documents gives term weights and, by a truncated singular value decomposition, a few latent
dimensions; the sample's latent vectors and labels are broadcast (at most SAMPLE vectors of DIMENSIONS float32, so a
few MB whatever the corpus). Every document is then projected, its cosine with every labelled vector is computed
exactly in blocks, and its nearest neighbours vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, mix, raw, slices
from .words import words

#: Bound of the fit: labelled rows of each label. All texts teach and are scored whole.
SAMPLE = 3_000
DIMENSIONS, NEIGHBOURS, TRIGRAMS = 48, 32, 1024

_CLASSES = np.full(256, 15, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t", b".", b",;:", b"!?", b"'\"`", b"-_", b"()[]{}", b"|", b"*#$%&@^~", b"<>/\\=+")):
    _CLASSES[list(_chars)] = _i
_CLASSES[128:] = 16
_N = 17
REPEATS = 6
TERMS = TRIGRAMS + _N * _N + REPEATS


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term frequencies (square roots of shares within each family) of texts given as bytes and offsets."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kind = _CLASSES[data]
    pair = np.nonzero(row[1:] == row[:-1])[0]
    out[:, TRIGRAMS : TRIGRAMS + _N * _N] = np.bincount(row[pair] * (_N * _N) + kind[pair] * _N + kind[pair + 1], minlength=n * _N * _N).reshape(n, -1)
    three = pair[:-1][np.diff(pair) == 1] if len(pair) > 1 else pair[:0]
    code = data[three].astype(np.uint32) | data[three + 1].astype(np.uint32) << np.uint32(8) | data[three + 2].astype(np.uint32) << np.uint32(16)
    code = (code * np.uint32(0x9E3779B1) >> np.uint32(22)).astype(np.int64)  # the top 10 bits
    out[:, :TRIGRAMS] = np.bincount(row[three] * TRIGRAMS + code, minlength=n * TRIGRAMS).reshape(n, -1)
    for family in (slice(0, TRIGRAMS), slice(TRIGRAMS, TRIGRAMS + _N * _N)):
        total = out[:, family].sum(axis=1, keepdims=True)
        out[:, family] = np.sqrt(out[:, family] / np.maximum(total, 1))
    word, first = words(data, offsets)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    if len(word):
        again = np.nonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1]))[0] + 1
        two = np.nonzero((word[2:] == word[:-2]) & (owner[2:] == owner[:-2]))[0] + 2
        share = lambda at: np.bincount(owner[at], minlength=n) / np.maximum(count, 1)
        key = mix(word + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, back, often = np.unique(key, return_inverse=True, return_counts=True)
        much = often[back] / np.maximum(count[owner], 1)
        found = (share(again), share(two), share(np.nonzero((much > 0.1) & (often[back] > 3))[0]), share(np.nonzero(often[back] == 1)[0]) * 0.5, share(np.nonzero(often[back] > 2 + 0.02 * count[owner])[0]) * 0.5, np.minimum(np.log1p(size / np.maximum(count, 1)) / 6, 1))
        for i, f in enumerate(found):
            out[:, TRIGRAMS + _N * _N + i] = f
    return out


class Voter:
    """The latent space with the labelled vectors in it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> None:
        x = x.astype(np.float64)
        self.mean, self.labels, self.neighbours = x.mean(axis=0).astype(np.float32), labels.astype(np.float32), min(neighbours, len(labels))
        weight = 1 / (x.std(axis=0) + 0.02)  # rare terms weigh more, as an inverse document frequency would have it
        weight[-REPEATS:] *= 2
        centred = (x - self.mean) * weight
        _, vectors = np.linalg.eigh(centred.T @ centred)  # the right singular vectors
        basis = vectors[:, ::-1][:, :dimensions]
        self.basis = (basis * weight[:, None]).astype(np.float32)
        self.vectors = unit(centred.astype(np.float32) @ basis.astype(np.float32))
        # each label as a whole weighs the same, so that the more frequent one doesn't win by number
        share = max(float(labels.mean()), 1e-9)
        self.weights = np.where(labels > 0, 0.5 / share, 0.5 / max(1 - share, 1e-9)).astype(np.float32)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.zeros(len(x), np.float64)
        for start in range(0, len(x), block):
            near = unit((x[start : start + block] - self.mean) @ self.basis) @ self.vectors.T
            top = np.argpartition(near, -self.neighbours, axis=1)[:, -self.neighbours :] if self.neighbours < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6) ** 4 * self.weights[top]
            out[start : start + block] = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def in_fold(ident: F.Column, folds: int, fold: int) -> F.Column:
    """Does crc32 of the id, written as text, leave this remainder?"""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == fold, F.lit(False))


def one_text(docs: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of a bounded number of chosen rows (doc_id, ...): of several texts of a doc_id that with the smallest hash."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", *columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Voter | None:
    """A voter from at most `sample` rows of each label 0 and 1 outside the held-out fold; None if there are none.

    The rows with the smallest hash of their id are taken, so the sample doesn't depend on the partitioning."""
    teach = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    first = lambda label: teach.where(F.col("quality") == label).distinct().orderBy(order, "doc_id").limit(sample)
    # at most 2 * sample ids: a bounded table
    rows = one_text(docs, first(0).union(first(1)), ["quality"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_most=1 << 18):
                x = terms(*raw(ids_of(part, "text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([ids_of(part), ids_of(part, "quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    found = rows.mapInArrow(features, "doc_id long, quality int, x binary").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    x = np.stack([np.frombuffer(b, np.float16) for b in found["x"].to_pylist()])
    return Voter(x, found["quality"].to_numpy())


def score_batches(voter: Voter | None, part: pa.RecordBatch) -> np.ndarray:
    """Without any labelled row every score is 1: nothing is known against a document."""
    if voter is None:
        return np.ones(part.num_rows)
    return voter.score(terms(*raw(ids_of(part, "text"))))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Null texts are scored as empty ones, long ones whole (a text needs about 60 times its bytes in memory). held_out is
    false for a null doc_id. Repeated rows of labels teach once, a doc_id with both labels teaches both, and of several
    texts of a doc_id one teaches; null labels don't teach. Repeated rows of docs are scored each. Empty tables give no
    rows; without labels scores are 1. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    voter = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([ids_of(part), ids_of(part, "held_out"), pa.array(score_batches(voter.value, part), pa.float64())], ["doc_id", "held_out", "score"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), in_fold(docs["doc_id"], 4, 2).alias("held_out"), "text")
    out = own.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold.

    Null texts, repeated rows and missing labels are as in quality_scores(); an empty table stays one."""
    voter = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(score_batches(voter.value, part) >= threshold))

    return docs.mapInArrow(run, docs.schema)
