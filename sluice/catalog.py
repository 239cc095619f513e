"""Registry of the rule engine's queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB form where SQL can express it."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry to alarms, events, coverage of windows and event metrics."""
    return QUERIES["d5_event_metrics"](spark, sf_dir)


from sluice.plans import (  # noqa: E402,F401
    control_queries, detect_queries, graph_queries, human_queries, match_queries, reshape_queries, score_queries, source_queries, text_queries,
)
