"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from launchsift.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


class Section:
    """Collects the queries of one area in declaration order."""

    def __init__(self) -> None:
        self.queries: list[Query] = []

    def add(self, name: str, sql: str | None = None):
        def register(build: Callable[[Tables], DataFrame]):
            self.queries.append(Query(name, build, sql))
            return build

        return register
