"""Registry of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_options
from . import adapters

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; ``sql`` is its oracle, prefixed with the adapter tables it ``needs``."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(apply_options(spark), folder)

        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = adapters.with_tables(sql, needs)
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
