"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take paths, only these queries know the names."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    return classes(table(spark, sf_dir, "documents"), k=2)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import captures

    return captures(table(spark, sf_dir, "pages"))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_byte_bpe, op3_near_dedup, op4_exact_dedup, op5_language, op6_packing, op7_warc, op8_byte_shards, op9_nearest, op10_token_counts)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Base32 of 40 hexadecimal digits: five of them are four letters.
_FIVE = "CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)"
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({_FIVE} >> {shift}) & 31 AS INTEGER), 1)" for shift in (15, 10, 5, 0))
_BASE32 = f"array_to_string(list_transform(range(8), lambda i: {_LETTERS}), '')"

#: CRC-32 byte by byte over the hexadecimal digits of a text, with its table of 256 remainders.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
                                  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
            FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))))"""
_HEX = "hex(encode(coalesce(text, '')))"
_BYTES = f"list_transform(range(CAST(length({_HEX}) // 2 AS BIGINT)), lambda i: CAST('0x' || substr({_HEX}, 2 * i + 1, 2) AS BIGINT))"
_CRC = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {_BYTES}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"

ORACLES = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < owner THEN owner END AS refers_to
        FROM d""",
    "op8_byte_shards": f"""
        WITH {_CRC_TABLE},
        d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_CRC} AS text_crc32,
                     min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS owner
              FROM documents, crc_table),
        r AS (SELECT *, sum(size) OVER w - size AS start, row_number() OVER w - 1 AS place, sum(size) OVER () AS total
              FROM d WINDOW w AS (ORDER BY owner NULLS FIRST, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT *, least(7, floor((start + size / 2.0) / (total / 8.0))) AS own FROM r),
        g AS (SELECT owner, min(own) AS low, max(own) AS high, min(start) AS a, max(start + size) AS b, max(total) AS total FROM c GROUP BY owner),
        s AS (SELECT c.*, CAST(CASE WHEN low < high AND b - a <= g.total / 8.0 * 0.002 THEN least(7, floor((a + b) / 2.0 / (g.total / 8.0))) ELSE own END AS INTEGER) AS shard
              FROM c JOIN g ON c.owner IS NOT DISTINCT FROM g.owner)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM s""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
