"""All queries of the core, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, general, quality, records, scalars

_PARTS = [general, scalars, analytics, quality, records]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.oracle_sql().items()}
