"""Registry of named queries: a Spark callable (spark, sf_dir) -> DataFrame and,
where the operator is expressible in SQL, the equivalent DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    doc: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from riskframe.plans import (  # noqa: F401
        q_cases, q_drift, q_encode, q_explain, q_fairness, q_features, q_guard, q_lookup, q_models, q_monitor, q_profile, q_ranking, q_ranking2, q_split, q_stream,
    )


def all_queries() -> dict[str, Query]:
    _load_all()
    return dict(_REGISTRY)
