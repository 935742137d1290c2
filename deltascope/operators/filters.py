"""Row filters of the form `column = value`, blind to case and surrounding blanks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from deltascope.functions.text import as_text, strip

Filters = list[tuple[str, str]]


def matches(df: DataFrame, column: str, value: str) -> Column:
    return F.lower(strip(as_text(df, column))) == F.lit(str(value).strip().lower())


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Keep the rows that match every filter."""
    return df.filter(reduce(and_, (matches(df, c, v) for c, v in filters))) if filters else df


def values_present(df: DataFrame, filters: Filters) -> list[bool]:
    """Does each filter match any row at all? One aggregate answers for all of them."""
    if not filters:
        return []
    found = df.agg(*[F.max(matches(df, c, v)).alias(f"f{i}") for i, (c, v) in enumerate(filters)]).first()
    return [bool(found[f"f{i}"]) for i in range(len(filters))]


def require_rows(df: DataFrame, filters: Filters) -> DataFrame:
    """The filtered table, or an error when the filters leave nothing."""
    scoped = apply_filters(df, filters)
    if filters and scoped.isEmpty():
        raise ValueError(f"The filters {describe_filters(filters)} leave an empty table.")
    return scoped


def describe_filters(filters: Filters) -> str:
    return ", ".join(f"{column} = {value!r}" for column, value in filters)
