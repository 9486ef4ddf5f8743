"""All queries of the engine, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries when they are imported.
CATALOGS = ("search", "indexes", "names", "relations", "measures", "history", "graphs", "texts", "exploration", "code", "rules", "context", "planning", "grammars", "nesting", "segments", "streams", "effects", "trees")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in CATALOGS:
        import_module(f"loomtext.plans.catalog_{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["search_top_files"](spark, sf_dir)


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
