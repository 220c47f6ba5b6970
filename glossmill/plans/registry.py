"""All queries of the library proper: name -> callable, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that register queries.
MODULES = ["q_eval", "q_profiles", "q_splits", "q_segments", "q_stats", "q_vocab", "q_landmarks", "q_captions", "q_context", "q_readers", "q_more"]

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that returns the same rows where there is such SQL."""

    def keep(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"glossmill.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["eval_summary"](spark, sf_dir)
