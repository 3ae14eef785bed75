"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Adds a function of (spark, sf_dir) under `name`."""

    def add(f):
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLE[name] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def _load() -> None:
    """Imports the modules that register queries."""
    from crossgrain.plans import experiment_queries, graph_queries, kernel_queries, panel_queries, portfolio_queries  # noqa: F401
