"""Named queries over the test tables, each next to the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def texts(self, *columns: str) -> DataFrame:
        """Documents for costly per-row work; see ``spread``."""
        return spread(self.documents.select(*columns))


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


# Engines and partitions add doubles in different orders, so a mean that lies on a rounding
# tie could go either way. Both sides move values off the ties before they round.
def r6(column: Column | str) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(2.7182818e-9), 6)


def r4(column: Column | str) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(2.7182818e-7), 4)
