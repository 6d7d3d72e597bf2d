"""Registry of the named queries: a Spark builder and (when the operator is
SQL-expressible) the DuckDB oracle SQL over the same parquet tables.

Query keys follow ``<operator id><noun>``, e.g. ``cus4_rfm``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class QuerySpec:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, QuerySpec] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        from ledgerlens.plans.common import sql_round
        REGISTRY[key] = QuerySpec(key, fn, sql_round(sql) if sql else None)
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    # importing the modules registers their queries
    from ledgerlens.plans import (  # noqa: F401
        q_value, q_features, q_basket, q_churn, q_stats, q_metrics, q_reports, q_segments, q_charts)
    return REGISTRY
