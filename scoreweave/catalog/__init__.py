"""Registered queries: every operator run over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name; ``sql`` is the DuckDB statement it must match."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


def load() -> None:
    """Import every catalogue module once."""
    from . import aggregates, behaviour, folds, joins, maps, prepare, rsa, scans, streams, vectors, windows  # noqa: F401
