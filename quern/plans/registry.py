"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources.tables import table


class Tables:
    """Tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers a function of Tables under its own name."""

        def wrap(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return wrap
