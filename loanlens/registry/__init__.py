"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlens.registry import (
    bureau,
    clients,
    evaluation,
    explaining,
    modelling,
    preparation,
    previous,
    profiling,
    resampling,
    scoring,
)

MODULES = (previous, bureau, clients, profiling, preparation, evaluation, resampling, modelling, explaining, scoring)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
