"""Which columns can serve as metric, time axis or dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltascope.functions import fixed
from deltascope.functions.text import is_datetime, quoted
from deltascope.operators.profile import TableProfile


def metric_candidates(prof: TableProfile) -> list[str]:
    """Numeric columns; those named like a code come last but stay."""
    numeric = [c for c in prof.columns if c.semantic_type in ("numeric", "numeric_as_string")]
    return [c.name for c in sorted(numeric, key=lambda c: c.code_named)]


def time_axis_candidates(prof: TableProfile) -> list[str]:
    """Dates first; a year serves when there is no date."""
    return prof.of_type("date", "date_as_string") + prof.of_type("year")


def dimension_candidates(prof: TableProfile) -> list[str]:
    return prof.of_type("categorical", "boolean")


def too_granular(prof: TableProfile, name: str) -> bool:
    """A label per entity rather than a segment: many values and a large share of the rows."""
    if name not in prof.names or not prof.n_rows:
        return False
    distinct = prof[name].unique_count
    return distinct > fixed.GRANULAR_MIN_DISTINCT and distinct > fixed.GRANULAR_MIN_RATIO * prof.n_rows


def granularity(prof: TableProfile) -> DataFrame:
    """The guard's verdict on every column."""
    return prof.spark.createDataFrame(
        [(c.name, c.unique_count, prof.n_rows, too_granular(prof, c.name)) for c in prof.columns],
        "name string, unique_count bigint, n_rows bigint, too_granular boolean",
    )


def time_axes(prof: TableProfile, df: DataFrame) -> DataFrame:
    """The range of every candidate axis, not only of the first: `(axis, kind, first, last)`."""
    axes = [a for a in time_axis_candidates(prof) if a in df.columns]
    schema = "axis string, kind string, first string, last string"
    if not axes:
        return df.sparkSession.createDataFrame([], schema)

    def bound(pick, name):
        column = F.col(quoted(name))
        return pick(column.cast("date") if is_datetime(df.schema[name].dataType) else column).cast("string")

    row = df.agg(
        *[bound(pick, a).alias(f"{end}{i}") for i, a in enumerate(axes) for end, pick in (("first", F.min), ("last", F.max))]
    ).first()
    found = [
        (a, "date" if is_datetime(df.schema[a].dataType) else "annual", row[f"first{i}"], row[f"last{i}"])
        for i, a in enumerate(axes) if row[f"first{i}"] is not None
    ]
    return df.sparkSession.createDataFrame(found, schema)
