"""Names the queries and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from urlguard.plans.inputs import Inputs, check_sql

Build = Callable[[Inputs], DataFrame]


class Registry:
    def __init__(self, tables: dict[str, str] | None = None):
        self.builds: dict[str, Build] = {}
        self.checks: dict[str, str] = {}
        # Named sub-queries that only the SQL checks use.
        self.tables = tables or {}

    def add(self, name: str, build: Build, sql: str | None = None) -> None:
        if name in self.builds:
            raise ValueError(f"query {name} exists")
        self.builds[name] = build
        if sql is not None:
            self.checks[name] = sql

    def query(self, name: str, sql: str | None = None):
        """Decorator form of :meth:`add`."""

        def register(build: Build) -> Build:
            self.add(name, build, sql)
            return build

        return register

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(build: Build):
            return lambda spark, folder: build(Inputs(spark, folder))

        return {name: bind(build) for name, build in self.builds.items()}

    def sql(self) -> dict[str, str]:
        return {name: check_sql(text, self.tables) for name, text in self.checks.items()}
