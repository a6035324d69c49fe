"""Registry of the engine's queries with their SQL counterparts.

Each family module registers functions ``f(t)`` of a
:class:`wardlight.sources.views.Tables`; the optional SQL text gives the same
rows on the same Parquet tables in any ANSI engine.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlight.plans.session import tune
from wardlight.sources.views import Tables

_FAMILIES = (
    "sources profile canon audit kpi metrics journal traces corpus retrieval "
    "model evaluation memory streams"
).split()
_queries: dict[str, Callable[[Tables], DataFrame]] = {}
_sql: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        if name in _queries:
            raise ValueError(f"{name} registered twice")
        _queries[name] = fn
        if sql:
            _sql[name] = sql
        return fn

    return add


def _load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"wardlight.checks.{family}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(tune(spark), sf_dir))

    return {name: bind(fn) for name, fn in _queries.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
