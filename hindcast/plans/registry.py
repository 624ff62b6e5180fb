"""All queries of the engine itself, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hindcast.plans import analogues, cascades, comparisons, cones, densities, extras, headlines, inference, market, measures, posterior, text

MODULES = (market, text, analogues, posterior, measures, extras, cascades, densities, inference, cones, headlines, comparisons)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
