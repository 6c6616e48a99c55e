"""All registered queries of the spatial engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import q_chains, q_geometry, q_graph, q_grid, q_labels, q_mesh, q_models, q_more, q_props, q_scan, q_sources, q_spatial, q_time  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["density_grid"](spark, sf_dir)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
