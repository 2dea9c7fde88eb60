"""Query catalogue: name -> Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the result is expressible in SQL, the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def oracle_of(name: str) -> str:
    """The oracle of a query that is registered already, for another one that must give the same rows."""
    return _ORACLES[name]


def _load_all() -> None:
    # Importing the plan modules registers their queries.
    from ledgerlens.plans import (  # noqa: F401
        evaluation, validation, exports, costs, admission, intake, evidence, streams, files, replays)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
