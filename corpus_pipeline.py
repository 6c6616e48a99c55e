"""A training corpus from raw documents: quality, language, exact and near duplicates, then packed sequences.

Every stage is one of the operators of terravox.llm over all that its predecessor kept; each stage's rows are written
as Parquet in the shared folder and read again for the next. Extra columns go along up to packing, which has its own;
a stage of an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravox.llm.common import written
from terravox.llm.exact_dedup import keep_owners
from terravox.llm.langid import keep_languages
from terravox.llm.near_dedup import keep_first_of_each
from terravox.llm.packing import pack_documents
from terravox.llm.quality import keep_quality
from terravox.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7, by the labels of sf_dir. Null texts are scored as empty, repeated rows each; without labels all stay."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is better than a guess. Null and letterless texts go; repeated rows are judged each."""
    return keep_languages(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (case of A-Z aside) that with the largest doc_id. Rows without a doc_id and repeated rows of an owner stay; null is empty."""
    return keep_owners(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shares 0.8 of its five-word shingles the smallest doc_id. Rows without a doc_id or without words stay."""
    return keep_first_of_each(docs, k=5, similarity=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096; null and empty texts are the end id alone."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("language ID", language), ("exact dedup", exact_duplicates), ("MinHash near-dedup", near_duplicates), ("best-fit packing", packing)]

#: Nearest-neighbour votes, n-gram filters and token ids have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
