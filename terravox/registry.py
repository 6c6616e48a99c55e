"""A registry of named queries with their SQL, filled by decorators in the query modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Later:
    """A module of this package that is imported at its first use: operators build Columns, which takes a session, while names and SQL don't."""

    def __init__(self, name: str) -> None:
        self._name = f"terravox.{name}"

    def __getattr__(self, attribute: str):
        return getattr(importlib.import_module(self._name), attribute)


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; sql may use the named views (see plans.views)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        from .plans.views import with_views

        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = with_views(sql, views)
        return f

    return add
