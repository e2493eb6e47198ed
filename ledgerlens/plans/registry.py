"""A named query: how to build it, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Build] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Build], Build]:
        def keep(build: Build) -> Build:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = build
            if sql is not None:
                self.sql[name] = sql
            return build

        return keep
