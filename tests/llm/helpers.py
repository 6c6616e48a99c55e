"""Small tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int"
SF = "/root/testdata/sf0.001"


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, odd characters, clashing column names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(80))
    near = base.replace(base.split()[40], "changed", 1)
    rows = [
        (1, base), (2, base.upper()), (3, near), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "ONE"), (9, "two words"), (9, "two words"), (None, "no id"), (None, base), (10, "x" * 200_000),
        (11, " ".join(word() for _ in range(40_000))), (12, "12 34 — !!"), (13, "naïve ∆ 漢字   end ."), (14, "a  b\n\nc \n d\r\n"), (15, "<|endoftext|> <s> it's 'll ▁▁x"), (16, base + " tail"),
    ]
    return spark.createDataFrame([(i, t, [None, "en", "de"][k % 3], None, None, "clash", 7) for k, (i, t) in enumerate(rows)], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def crc(ident: int | None, folds: int, fold: int) -> bool:
    return ident is not None and zlib.crc32(str(ident).encode()) % folds == fold


def shingle_set(text: str | None, k: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def components(sets: dict[int, frozenset], similarity: int = 80) -> dict[int, int]:
    """Smallest reachable id by comparing every pair."""
    parent = {i: i for i in sets}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
