"""Queries over the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its equivalent SQL, if SQL can say it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load_all() -> None:
    from registry import (  # noqa: F401
        accuracy_queries, agreement_queries, corpus_queries, file_queries, pair_queries, report_queries,
        sampling_queries, scoring_queries, statistics_queries, table_queries,
    )
