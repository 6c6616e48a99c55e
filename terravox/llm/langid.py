"""Language by bit-sliced Bloom filters: one lookup gives all languages that have an n-gram.

The filters of all languages share their hash functions and lie across the bits of one array, with a 64-bit word at
each position for every 64 languages: bit l of row j is position j of language l's filter. The AND of an n-gram's words is the mask of languages that contain it. A text's
masks are counted bit by bit; from each language's count goes what its filter's false positives would add by chance;
the largest share decides. Languages are learned from the values of `lang`; a text without a letter is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, ids_of, mix, raw, slices, written
from .quality import in_fold

#: Bounds of the fit: teaching rows of a language, of all languages, and rows of each that this leaves at least. All texts teach and are predicted whole.
SAMPLE, TEACHING, LEAST = 500, 32_000, 20
#: n-gram length in bytes, share of a language's texts that have an n-gram before it is taken in, words of the array, and hash functions.
N, COMMON, WORDS, HASHES = 5, 0.05, 1 << 18, 3

UNDETERMINED = "und"


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each n-gram of bytes that lies inside one text, A-Z lower-cased."""
    if len(data) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[data].astype(np.uint64)
    code = np.zeros(len(data) - N + 1, np.uint64)
    for i in range(N):
        code |= low[i : len(data) - N + 1 + i] << np.uint64(8 * i)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(code)] == row[N - 1 :]
    return mix(code[inside]), row[: len(code)][inside]


def with_letters(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(text.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)


class LanguageFilters:
    def __init__(self, languages: list[str], grams: list[np.ndarray], words: int = WORDS) -> None:
        self.languages, self.mask = languages, np.uint64(words - 1)
        self.table = np.zeros((words, -(-len(languages) // 64)), np.uint64)
        for bit, own in enumerate(grams):
            for at in self.places(own):
                self.table[at, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        # what a filter says of an n-gram it doesn't hold
        fill = np.array([float((self.table[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).mean()) for b in range(len(languages))])
        self.chance = fill**HASHES

    def places(self, gram: np.ndarray) -> list[np.ndarray]:
        """Slices of one 64-bit hash as positions."""
        return [(gram >> np.uint64(20 * i) & self.mask).astype(np.int64) for i in range(HASHES)]

    def languages_of(self, gram: np.ndarray) -> np.ndarray:
        a, *rest = self.places(gram)
        out = self.table[a]
        for at in rest:
            out &= self.table[at]
        return out

    def predict(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Language and share of the language for each text."""
        data, offsets = raw(text)
        gram, row = ngrams(data, offsets)
        n = len(offsets) - 1
        masks, total = self.languages_of(gram), np.bincount(row, minlength=n)
        # texts whose n-grams no filter knows: the first language, with no confidence
        best, most, every = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        there = np.bitwise_or.reduce(masks, axis=0)
        for b, chance in enumerate(self.chance):
            slot, bit = b // 64, np.uint64(b % 64)
            if not there[slot] >> bit & np.uint64(1):
                continue
            hits = np.bincount(row[(masks[:, slot] >> bit & np.uint64(1)).astype(bool)], minlength=n)
            true = np.maximum((hits - total * chance) / (1 - chance), 0)
            best[true > most] = b
            most, every = np.maximum(most, true), every + true
        share = most / np.maximum(every, 1e-9)
        letters = with_letters(text)
        found = np.where(letters, np.array(self.languages, object)[best], UNDETERMINED)
        return pa.array(found.tolist(), pa.string()), np.where(letters, share, 0.0)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct n-grams, one a row."""
    for batch in batches:
        for part in slices(batch, at_most=1 << 18):
            gram, row = ngrams(*raw(ids_of(part, "text")))
            both = np.unique(np.stack([row.astype(np.uint64), gram], axis=1), axis=0) if len(gram) else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([ids_of(part, "lang").take(pa.array(both[:, 0].astype(np.int64))), pa.array(both[:, 1].view(np.int64))], ["lang", "gram"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageFilters | None:
    """Filters from at most `sample` rows of each language outside the held-out fold; None if there are none.

    Every value of lang outside that fold is learned, from whole texts; with many of them each has fewer rows, TEACHING
    together but LEAST at least. Of each the doc_ids with the smallest hash teach, once each. An n-gram is taken in
    if COMMON of the language's texts have it, so there are at most 1 / COMMON times as many as a text has on average."""
    teach = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 5, 0))
    hashed = teach.select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.lit(5)).alias("h"))
    counts = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
    many = counts.count()
    sample = min(sample, max(LEAST, TEACHING // max(1, many)))
    # a threshold on the hash thins each language to little more than the bound before rows meet in a window
    share = F.least(F.lit(1.0), (F.lit(sample) * 1.5 + 50) / F.col("ids"))
    counts = F.broadcast(counts) if many <= TEACHING else counts
    thin = hashed.join(counts, "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "doc_id", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = thin.withColumn("place", place).where(F.col("place") <= sample).select("doc_id", "lang")
    # at most `sample` rows a language; of several texts of a doc_id that with the smallest hash teaches
    rows = teach.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    rows = written(rows, "teaching")
    taught = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not taught:
        return None
    often = rows.mapInArrow(_grams, "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("often"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("texts"))
    found = often.join(F.broadcast(sizes), "lang").where(F.col("often") >= F.greatest(F.lit(1.0), F.col("texts") * COMMON)).select("lang", "gram").toArrow()
    languages = sorted(taught)
    lang, gram = found["lang"].to_numpy(zero_copy_only=False), found["gram"].to_numpy().view(np.uint64)
    return LanguageFilters(languages, [gram[lang == name] for name in languages])


def predict_part(filters: LanguageFilters | None, part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    if filters is None:
        return pa.array([UNDETERMINED] * part.num_rows, pa.string()), np.zeros(part.num_rows)
    return filters.predict(ids_of(part, "text"))


def languages(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang, ...): doc_id, held_out, lang_pred, score (0 to 1).

    Null texts and texts without a letter are `und` with score 0, and so is every text if no row has a language to
    learn. Long texts are read whole (about 60 times a text's bytes at once). held_out is false for a null doc_id, and
    such rows don't teach; a doc_id teaches each of its languages once. Ties go to the language first in order.
    Repeated rows are predicted each; empty tables give no rows. Other columns are ignored, whatever their names.
    """
    filters = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = predict_part(filters.value, part)
                yield pa.RecordBatch.from_arrays([ids_of(part), ids_of(part, "held_out"), lang, pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), in_fold(docs["doc_id"], 5, 0).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, margin: float = 1.2, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs, all columns, with a language: not `und`, `margin` times the share that chance gives (1 over the number of languages), and one of `wanted` if given.

    Null texts have no letter and go; repeated rows are judged each; an empty table stays one.
    With one language to learn from there is no share to compare, and with none no text has a language but `und`: all
    texts with a letter are kept then (with `wanted`, only those whose language is known to be one of them)."""
    filters = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = predict_part(filters.value, part)
                keep, many = with_letters(ids_of(part, "text")), len(filters.value.languages) if filters.value else 0
                keep = pa.array(keep & (score * many >= margin) if many > 1 else keep)
                yield part.filter(pc.and_(keep, pc.is_in(lang, pa.array(wanted))) if wanted else keep)

    return docs.mapInArrow(run, docs.schema)
