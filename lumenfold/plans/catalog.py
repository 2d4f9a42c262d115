"""All queries over the reference's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.plans import chains, intake, operations, pages, retrieval, sources, stores, streams, versions

MODULES = (retrieval, pages, operations, sources, versions, intake, stores, streams, chains)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
