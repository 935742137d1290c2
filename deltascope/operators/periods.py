"""Time axes, period totals, and the choice of the two periods to compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from deltascope.functions.text import is_datetime, plain_number, present, quoted
from deltascope.functions.time import frequency, period_bounds, period_label, period_start, year_label


@dataclass(frozen=True)
class TimeAxis:
    """A column that places rows in periods: a date, or a whole number such as a year."""

    column: str
    data_type: T.DataType
    freq: str

    @property
    def dated(self) -> bool:
        return is_datetime(self.data_type)

    @property
    def value(self) -> Column:
        """The raw column; numeric text is parsed, so that it compares as a number."""
        column = F.col(quoted(self.column))
        return plain_number(column) if isinstance(self.data_type, T.StringType) else column

    @property
    def start(self) -> Column:
        """Grouping key of a row's period."""
        return period_start(self.value, self.freq) if self.dated else self.value.cast("bigint")

    def label(self, start: Column) -> Column:
        return period_label(start, self.freq) if self.dated else year_label(start)

    def knows(self, label: str) -> bool:
        """Is this a well-formed label on this axis?"""
        if self.dated:
            return period_bounds(label, self.freq) is not None
        return label.lstrip("-").isdigit()

    def within(self, label: str) -> Column:
        """Rows of one period, as a range on the raw column so that it reaches the scan."""
        if not self.dated:
            return self.value == F.lit(int(label))
        start, end = (self._literal(x) for x in period_bounds(label, self.freq))
        return (self.value >= start) & (self.value < end)

    def up_to(self, label: str) -> Column:
        """Rows of this period and all before it. Whole-number labels compare as text."""
        if not self.dated:
            return year_label(self.value) <= F.lit(label)
        return self.value < self._literal(period_bounds(label, self.freq)[1])

    def _literal(self, instant) -> Column:
        # a literal of the column's own type: otherwise the column would be cast instead,
        # and a cast column is not pushed down
        return F.lit(instant.isoformat(sep=" ")).cast(self.data_type)


def time_axis(df: DataFrame, column: str, freq: str = "M") -> TimeAxis:
    """Check that a column can be a time axis; never read a year as a timestamp."""
    axis = TimeAxis(column, df.schema[column].dataType, frequency(freq))
    data_type = axis.data_type
    if axis.dated or isinstance(data_type, T.IntegralType):
        return axis
    if isinstance(data_type, (T.StringType, T.NumericType)):
        number = axis.value
        seen = df.filter(present(df, column)).agg(
            F.count(number).alias("n"), F.bool_and(number % 1 == 0).alias("whole")
        ).first()
        if seen["n"] and seen["whole"]:
            return axis
    raise ValueError(
        f"{column!r} holds neither dates nor whole numbers; a time axis needs one of them."
    )


def amount(df: DataFrame, metric: str) -> Column:
    """The metric as something that can be summed; a flag counts as 0 or 1."""
    data_type = df.schema[metric].dataType
    if isinstance(data_type, T.BooleanType):
        return F.col(quoted(metric)).cast("int")
    if not isinstance(data_type, T.NumericType):
        raise ValueError(f"{metric!r} can't be summed, its type is {data_type.simpleString()}.")
    return F.col(quoted(metric))


def valid_rows(df: DataFrame, metric: str, axis: TimeAxis) -> DataFrame:
    """Rows that have both a time and a metric."""
    rows = df.filter(present(df, axis.column) & present(df, metric))
    if isinstance(axis.data_type, T.StringType):
        rows = rows.filter(axis.value.isNotNull())
    return rows


def period_totals(df: DataFrame, metric: str, date_column: str, freq: str = "M") -> DataFrame:
    """Sum of the metric per period, in order of period: `(period, total)`."""
    axis = time_axis(df, date_column, freq)
    return _totals(valid_rows(df, metric, axis), amount(df, metric), axis).orderBy("period")


def trend(df: DataFrame, metric: str, date_column: str) -> DataFrame:
    """Monthly sums, for a chart."""
    return period_totals(df, metric, date_column, "M")


def _totals(rows: DataFrame, value: Column, axis: TimeAxis) -> DataFrame:
    return (
        rows.groupBy(axis.start.alias("start"))
        .agg(F.sum(value).alias("total"))
        .select(axis.label(F.col("start")).alias("period"), "total")
    )


@dataclass(frozen=True)
class PeriodPair:
    before: str
    after: str
    total_before: float
    total_after: float


def choose_periods(
    df: DataFrame, metric: str, axis: TimeAxis, period_after: str | None = None, period_before: str | None = None
) -> PeriodPair:
    """The period asked about (the latest by default) and the nearest earlier one present.

    Only the two chosen rows come to the driver, whatever the number of periods, and a
    named period limits what is scanned: nothing later than it is read, and with both named
    nothing else is.
    """
    rows = valid_rows(df, metric, axis)
    for label in (period_after, period_before):
        if label is not None and not axis.knows(label):
            raise ValueError(_unknown(label, rows, metric, axis))
    scope = rows
    if period_after is not None and period_before is not None:
        if period_before >= period_after:
            raise ValueError(f"Period {period_before!r} is not before {period_after!r}.")
        scope = rows.filter(axis.within(period_after) | axis.within(period_before))
    elif period_after is not None:
        scope = rows.filter(axis.up_to(period_after))
    totals = _totals(scope, amount(df, metric), axis)
    if period_before is not None and period_after is None:
        latest = totals.agg(F.max("period")).first()[0]
        if latest is None or period_before >= latest:
            raise ValueError(_unknown(period_before, rows, metric, axis))
        totals = totals.filter(F.col("period").isin(period_before, latest))
    latest_two = totals.orderBy(F.desc("period")).limit(2).collect()
    if len(latest_two) == 2 and period_after in (None, latest_two[0]["period"]):
        after, before = latest_two
        return PeriodPair(before["period"], after["period"], before["total"], after["total"])
    raise ValueError(_why_not(rows, metric, axis, period_after, period_before))


def _why_not(rows, metric, axis, period_after, period_before) -> str:
    """Explain, at the price of one more look at the data, why no pair was found."""
    seen = _totals(rows, F.lit(1), axis).agg(F.count("*"), F.min("period")).first()
    if seen[0] == 0:
        return f"No rows with both '{axis.column}' and '{metric}' present."
    if seen[0] < 2:
        return f"Need at least two {axis.freq}-periods; found {seen[0]}."
    for label in (period_after, period_before):
        if label is not None and rows.filter(axis.within(label)).isEmpty():
            return _unknown(label, rows, metric, axis)
    return f"No period before {period_after!r} to compare against."


def _unknown(label, rows, metric, axis) -> str:
    first, last = _totals(rows, F.lit(1), axis).agg(F.min("period"), F.max("period")).first()
    return f"Period {label!r} not in data. Available: {first} to {last}."
