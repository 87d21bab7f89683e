"""Training-data operators: deduplication, filtering, search, mixing and packing of text corpora.

``QUERIES`` and ``ORACLES`` hold the registered queries of the subpackage; ``load`` fills them.
"""

from __future__ import annotations

QUERIES: dict = {}
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
    from . import queries  # noqa: F401
