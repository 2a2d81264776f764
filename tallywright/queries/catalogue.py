"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywright.queries import operations  # noqa: F401  adds its queries to those of reference
from tallywright.queries import problems, problems_sql, reference, rule_shapes

_MODULES = [(problems.QUERIES, problems_sql.SQL), (rule_shapes.QUERIES, rule_shapes.SQL), (reference.QUERIES, reference.SQL)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for own, _ in _MODULES for name, f in own.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for _, own in _MODULES for name, sql in own.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.severity_surface_cube(spark, sf_dir)
