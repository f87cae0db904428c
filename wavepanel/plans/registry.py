"""Registered queries: a Spark DataFrame builder per operator and, where the
operator is SQL-expressible, the equivalent DuckDB SQL over the same tables.

Each Spark builder takes ``(spark, sf_dir)`` and reads whole tables; nothing
is sampled or capped except where the cap is the feature (top-k reports).
Every computed column is aliased identically on both sides; floats are
rounded in both to the same number of decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    # Importing the query modules fills the registry.
    import importlib
    for mod in QUERY_MODULES:
        importlib.import_module(f"wavepanel.plans.{mod}")


QUERY_MODULES = ["q_change", "q_clean", "q_describe", "q_impute", "q_correlate", "q_hypothesis",
                 "q_mixed", "q_series", "q_plotdata", "q_reshape", "q_derive", "q_sources"]
