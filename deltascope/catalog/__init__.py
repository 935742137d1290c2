"""Named queries over the test tables, each with the SQL that must give the same result.

Every query reads whole tables, or whole tables that Spark derives from them. Figures are
rounded on both sides, since sums of doubles depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        key = name or run.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key!r} is registered twice")
        REGISTRY[key] = Entry(key, run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, columns: Iterable[str]) -> DataFrame:
    """Round, and fold -0.0 into 0.0."""
    for name in columns:
        df = df.withColumn(name, F.round(F.col(name), digits) + F.lit(0.0))
    return df


def load() -> dict[str, Entry]:
    from deltascope.catalog import audit, change, profiling, statistics, tables  # noqa: F401

    return REGISTRY
