"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a DataFrame over the driver
tables; they are what ``__spark_entry__.queries()`` exposes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from slatewise.plans import (  # noqa: F401
        metric_queries,
    )
    for mod in ("slate_queries", "feature_queries", "candidate_queries", "sampling_queries",
                "history_queries", "ensemble_queries", "summary_queries", "source_queries",
                "stream_queries", "model_queries"):
        try:
            __import__(f"slatewise.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"slatewise.plans.{mod}":
                raise
