"""Column expressions on messy text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from deltascope.functions import fixed


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once and written into the plan once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(column: Column) -> Column:
    """Trim every kind of white space. `trim` with a character list only looks at the
    two ends of a value, so it is far cheaper per row than a regular expression."""
    return F.trim(column, F.lit(fixed.WHITESPACE))


def is_null_token(column: Column) -> Column:
    """True for null and for text that stands for a missing value."""
    return column.isNull() | F.lower(strip(column)).isin(*fixed.NULL_TOKENS)


def clean_text(column: Column) -> Column:
    """Trimmed text; null where the value is missing or stands for missing."""
    return F.when(~is_null_token(column), strip(column))


def category_key(spelling: Column) -> Column:
    """The key under which spellings of one category fold together."""
    return F.when(is_null_token(spelling), F.lit(fixed.MISSING)).otherwise(F.lower(strip(spelling)))


def plain_number(column: Column) -> Column:
    """Numeric text to double, null where it is not a plain decimal number.

    Extracting by the pattern keeps out what a cast would take on top of that, such as
    `1.0d`, and evaluates the text only once.
    """
    plain = F.regexp_extract(strip(column), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0)
    return plain.try_cast("double")


def coerce_numeric(column: Column) -> Column:
    """Currency, percentage and accounting text to double.

    Percentages become fractions and a value in parentheses is negated, so `(-5)`,
    negated twice, is 5.
    """
    text = strip(column)
    magnitude = plain_number(F.regexp_replace(text, r"[$€£¥,()%\s]", ""))
    sign = F.when(text.startswith("(") & text.endswith(")"), -1.0).otherwise(1.0)
    unit = F.when(text.contains("%"), 100.0).otherwise(1.0)
    return sign * magnitude / unit


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def is_datetime(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def present(df: DataFrame, name: str) -> Column:
    """Neither null nor NaN."""
    column = F.col(quoted(name))
    if is_floating(df.schema[name].dataType):
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def as_text(df: DataFrame, name: str) -> Column:
    """Any column as text such that equal values, and only those, have equal text."""
    column, data_type = F.col(quoted(name)), df.schema[name].dataType
    if isinstance(data_type, T.StringType):
        return column
    if is_floating(data_type):
        # adding zero folds -0.0 into 0.0; NaN counts as missing
        return F.when(~F.isnan(column), (column + F.lit(0.0).cast(data_type)).cast("string"))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    if isinstance(data_type, T.BinaryType):
        return F.base64(column)
    return column.cast("string")


def quoted(name: str) -> str:
    """A column name that may hold dots or blanks, ready for `F.col`."""
    return "`" + name.replace("`", "``") + "`"
