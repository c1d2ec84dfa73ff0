"""All queries of the engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) under a name, with its DuckDB SQL if there is one."""

    def put(work):
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = work
        if sql is not None:
            SQL[name] = sql
        return work

    return put


def _load() -> None:
    from corvale.plans import catalog  # noqa: F401  registers on import


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_fusion"](spark, sf_dir)
