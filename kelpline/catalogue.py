"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelpline.plans import crawling, curation, evaluation, learning, records, reporting, stores, upkeep

MODULES = (evaluation, curation, crawling, learning, records, reporting, stores, upkeep)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
