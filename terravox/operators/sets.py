"""Set operations of point sets, by identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame, ident: str = "surfel_id") -> DataFrame:
    return a.unionByName(b).dropDuplicates([ident])


def intersect(a: DataFrame, b: DataFrame, ident: str = "surfel_id") -> DataFrame:
    return a.join(b.select(ident), ident, "left_semi")


def subtract(a: DataFrame, b: DataFrame, ident: str = "surfel_id") -> DataFrame:
    return a.join(b.select(ident), ident, "left_anti")


def append(a: DataFrame, b: DataFrame, where: F.Column | None = None) -> DataFrame:
    return a.unionByName(b if where is None else b.where(where))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def distinct(points: DataFrame, column: str) -> DataFrame:
    return points.select(column).distinct()
