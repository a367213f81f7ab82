"""All queries of the package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None, make: Callable[[Tables], DataFrame]) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is there already")
    _QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
    if sql:
        _SQL[name] = sql


def _load() -> None:
    from lariat.plans import frames, labelled, rows, text  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
