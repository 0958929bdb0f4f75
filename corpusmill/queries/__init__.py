"""Registered queries by area; each module fills its own tables of queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register a function of the tables under ``name``, with its DuckDB SQL if it has one."""

        def add(function: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return function

        return add
