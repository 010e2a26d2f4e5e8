"""Catalogue of registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes (spark, sf_dir) and returns a lazy DataFrame over
the driver tables; the oracle SQL reads the same tables through the fixture
projections in `territoria.sources.fixtures`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = (fn, sql)
        return fn
    return deco


def all_queries() -> dict[str, tuple[Builder, str | None]]:
    from . import catalog  # noqa: F401  (registers everything on import)
    return dict(_QUERIES)
