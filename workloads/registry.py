"""Pairs a query with its SQL under one name."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, opened on use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # found directly from now on
        return table


@lru_cache(maxsize=4)
def opened(spark: SparkSession, folder: str) -> Tables:
    """Tables are opened once per session; this reads their schemas, no rows."""
    return Tables(spark, folder)


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` and the SQL for the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(opened(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register
