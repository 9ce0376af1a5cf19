"""All queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedgraph.plans import queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.QUERIES


def oracles() -> dict[str, str]:
    return plans.ORACLES
