"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog
    return dict(catalog.ORACLES)
