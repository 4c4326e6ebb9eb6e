"""Every query of the library by name, with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortal.plans import arrangements, models, statistics, structure

FLAGSHIP = "welch_by_brand"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return statistics.QUERIES | structure.QUERIES | models.QUERIES | arrangements.QUERIES


def oracle_sql() -> dict[str, str]:
    return statistics.SQL | structure.SQL | models.SQL | arrangements.SQL
