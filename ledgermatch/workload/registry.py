"""Collect queries together with the SQL of their expected result."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.fixtures import relations

Query = Callable[[SparkSession, str], DataFrame]
Tables = Mapping[str, DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
        """Register ``function(tables) -> DataFrame`` under its own name."""

        def register(function: Callable[[Tables], DataFrame]) -> Callable:
            name = function.__name__
            self.queries[name] = lambda spark, sf_dir: function(relations(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql.strip()
            return function

        return register
