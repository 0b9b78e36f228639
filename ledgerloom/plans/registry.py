"""Collects the queries of every plan module, with their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules that register queries when they are imported.
PLAN_MODULES = ["portfolio_plans", "process_plans", "report_plans", "export_plans", "ingest_plans", "geometry_plans", "file_plans", "stream_plans", "record_plans"]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: add a query under ``name``, with its oracle SQL if it has one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return add


def _load() -> None:
    for name in PLAN_MODULES:
        importlib.import_module(f"ledgerloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
