"""Fully duplicated rows.

Only a 64-bit hash per row is shuffled to find the rows that can have a copy at all. Equal
rows have equal hashes, so no copy is missed; different rows that share a hash are told
apart afterwards by comparing all their columns. On wide tables with few copies this moves
a small part of what grouping by every column would move, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltascope.functions.text import quoted
from deltascope.sources.materialize import materialize

def _hash(df: DataFrame):
    return F.xxhash64(*[F.col(quoted(c)) for c in df.columns])


def suspects(df: DataFrame) -> DataFrame:
    """Hashes that occur more than once: `(__hash)`."""
    counted = df.select(_hash(df).alias("__hash")).groupBy("__hash").agg(F.count("*").alias("n"))
    return materialize(counted.filter("n > 1").select("__hash"), "suspects")


def _repeated(df: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Rows that may have a copy, grouped: all columns and `__n`, how often the row occurs."""
    rows = df.withColumn("__hash", _hash(df)).join(suspicious, "__hash", "left_semi")
    return rows.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count("*").alias("__n"))


def _surplus(groups: DataFrame) -> int:
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]


def count_duplicates(df: DataFrame) -> int:
    """How many rows equal an earlier one."""
    if not df.columns:
        return 0
    suspicious = suspects(df)
    return 0 if suspicious.isEmpty() else _surplus(_repeated(df, suspicious))


def deduplicate(df: DataFrame) -> tuple[DataFrame, int]:
    """Every distinct row once, and how many rows that leaves out.

    Rows whose hash is unique are certainly unique and pass by. The others are grouped once,
    into a table that also tells the number of surplus rows. The hashes are a written table,
    so whether the joins with them broadcast or shuffle follows from its size.
    """
    suspicious = suspects(df)
    if suspicious.isEmpty():
        return df, 0
    groups = materialize(_repeated(df, suspicious), "repeated")
    unique = df.withColumn("__hash", _hash(df)).join(suspicious, "__hash", "left_anti").drop("__hash")
    return unique.unionByName(groups.drop("__n")), _surplus(groups)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return deduplicate(df)[0]
