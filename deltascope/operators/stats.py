"""Plain statistics: what a change decomposition cannot express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltascope.functions import fixed
from deltascope.functions.text import as_text, category_key, present, quoted, strip
from deltascope.functions.time import parse_frequency
from deltascope.operators.periods import TimeAxis, amount, time_axis
from deltascope.operators.quantiles import medians
from deltascope.sources.materialize import materialize


def _value(df: DataFrame, column: str) -> Column:
    """The column as double, NaN as null."""
    return F.when(present(df, column), F.col(quoted(column)).cast("double"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over rows that have both values."""
    return _pairs(df, x, y).agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("n"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(_value(df, x).alias("x"), _value(df, y).alias("y")).dropna()


def topk_total(df: DataFrame, group: str, metric: str, k: int = 1) -> DataFrame:
    """The `k` groups with the largest sums. A top-k is kept per task, so the groups are
    never sorted as a whole."""
    return (
        df.filter(F.col(quoted(group)).isNotNull())
        .groupBy(F.col(quoted(group)).alias(group))
        .agg(F.sum(_summand(df, metric)).alias("total"))
        .orderBy(F.desc("total"), F.asc(quoted(group)))
        .limit(k)
    )


def _summand(df: DataFrame, metric: str) -> Column:
    return F.when(present(df, metric), amount(df, metric))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Number of categories, spelling variants counted once and missing values not at all."""
    key = category_key(strip(as_text(df, column)))
    return df.agg(F.count_distinct(F.when(key != fixed.MISSING, key)).alias("distinct_values"))


def mean(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(_value(df, column)).alias("mean"))


def median(df: DataFrame, column: str) -> DataFrame:
    """Exact median of a column of any size."""
    return df.sparkSession.createDataFrame([(medians(df, [column])[column],)], "median double")


def null_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(~present(df, column)).alias("null_count"))


def yes_count(df: DataFrame, column: str) -> DataFrame:
    """Rows in which a yes/no text says yes."""
    return df.agg(F.count_if(_says_yes(df, column)).alias("yes_count"))


def _says_yes(df: DataFrame, column: str) -> Column:
    return F.lower(strip(as_text(df, column))).isin(*fixed.YES_WORDS)


def share_of_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition, all rows, and the percentage."""
    return df.agg(F.count_if(condition).alias("matching"), F.count("*").alias("n")).withColumn(
        "pct", F.when(F.col("n") != 0, 100.0 * F.col("matching") / F.col("n"))
    )


def _pct(now: Column, before: Column) -> Column:
    return F.when(before != 0, 100 * (now - before) / before)


def _in_order(df: DataFrame, *order: Column) -> DataFrame:
    """Rows dealt out by ranges of `order`, with the number of their range as `_part`.

    Written, so that a row keeps its range whatever is computed again. Any whole number can
    be an axis, so there may be as many periods as rows: nothing may need them in one task.
    """
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "in-order")


def _with_previous(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """`before_<column>` of the row that comes before by `order`, within `by`.

    Inside a range a window finds it; the first row of a range takes the last one of the
    ranges before, a table of one row per range.
    """
    placed = _in_order(df, *[F.col(c) for c in by], F.col(order))
    row = F.struct(*columns)
    lasts = placed.groupBy("_part", *by).agg(F.max_by(row, order).alias("_last"))
    ends = lasts.withColumn("_end", F.lag("_last").over(Window.partitionBy(*by, F.lit(0)).orderBy("_part"))).drop("_last")
    inside = placed.withColumn("_row", F.lag(row).over(Window.partitionBy("_part", *by).orderBy(order)))
    joined = inside.join(ends, ["_part", *by], "left")
    before = F.coalesce("_row", "_end")
    return joined.select(*df.columns, *[before[c].alias(f"before_{c}") for c in columns])


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with its rows numbered from 1 in the order given."""
    placed = _in_order(df, *order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(offsets, "_part").withColumn("rank", (inside + F.col("_offset")).cast("int")).drop("_part", "_offset")


def mean_vs_sum_change(df: DataFrame, metric: str, date_column: str, freq: str = "M") -> DataFrame:
    """Mean and sum per period, each with its change, side by side: they can disagree in
    sign, and then a sum must not stand in for a mean."""
    axis, value = time_axis(df, date_column, freq), _value(df, metric)
    periods = (
        df.filter(present(df, date_column) & present(df, metric) & axis.start.isNotNull())
        .groupBy(axis.start.alias("start"))
        .agg(F.avg(value).alias("mean"), F.sum(value).alias("total"))
    )
    return (
        _with_previous(periods, [], "start", ["mean", "total"])
        .select(
            axis.label(F.col("start")).alias("period"), "mean", "total",
            _pct(F.col("mean"), F.col("before_mean")).alias("mean_pct_change"),
            _pct(F.col("total"), F.col("before_total")).alias("total_pct_change"),
        )
        .withColumn(
            "opposite_signs",
            F.coalesce(F.signum("mean_pct_change") * F.signum("total_pct_change") < 0, F.lit(False)),
        )
    )


def series(df: DataFrame, metrics: list[str], date_column: str, freq: str = "M") -> DataFrame:
    """Totals of several metrics per period, against the period before and the year before.

    One scan and one shuffle for all metrics; the rest works on one row per period.
    """
    axis = time_axis(df, date_column, freq)
    wide = (
        df.filter(present(df, date_column) & axis.start.isNotNull())
        .groupBy(axis.start.alias("start"))
        .agg(*[F.sum(_summand(df, m)).cast("double").alias(m) for m in metrics])
    )
    long = wide.unpivot("start", [quoted(m) for m in metrics], "metric", "total").filter(F.col("total").isNotNull())
    last_year = long.select(
        "metric", _year_later(axis, F.col("start")).alias("start"), F.col("total").alias("year_before")
    )
    return (
        _with_previous(long, ["metric"], "start", ["total"]).withColumnRenamed("before_total", "period_before")
        .join(last_year.groupBy("metric", "start").agg(F.max("year_before").alias("year_before")), ["metric", "start"], "left")
        .select(
            "metric", axis.label(F.col("start")).alias("period"), "total",
            (F.col("total") - F.col("period_before")).alias("change"),
            _pct(F.col("total"), F.col("period_before")).alias("pct_change"),
            (F.col("total") - F.col("year_before")).alias("year_change"),
            _pct(F.col("total"), F.col("year_before")).alias("year_pct_change"),
        )
    )


def _year_later(axis: TimeAxis, start: Column) -> Column:
    if not axis.dated:
        return start + 1
    freq = parse_frequency(axis.freq)
    if freq.seconds:
        return start + F.expr("INTERVAL '1' YEAR")
    if freq.unit == "W":
        return F.date_add(start, 364)  # the same weekday, 52 weeks on
    return F.add_months(start, 12)


def outlier_periods(df: DataFrame, metric: str, date_column: str, freq: str = "D", threshold: float = 2.0) -> DataFrame:
    """Periods ranked by how far their total lies from the mean of all periods, in standard
    deviations."""
    axis = time_axis(df, date_column, freq)
    totals = materialize(
        df.filter(present(df, date_column) & present(df, metric) & axis.start.isNotNull())
        .groupBy(axis.start.alias("start")).agg(F.sum(_value(df, metric)).alias("total"))
        .select(axis.label(F.col("start")).alias("period"), "total"), "period-totals"
    )
    around = totals.agg(F.avg("total").alias("mean"), F.stddev_samp("total").alias("spread")).first()
    distance = F.col("total") - F.lit(around["mean"])
    z = distance / F.lit(around["spread"]) if around["spread"] else F.lit(0.0)
    scored = totals.withColumn("z", z).withColumn("_far", F.abs("z"))
    return _ranked(scored, F.desc("_far"), F.asc("period")).drop("_far").withColumn("unusual", F.abs("z") >= threshold)


def slope(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of `y` on `x`, how much of the spread it explains, and the spread."""
    return _pairs(df, x, y).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.corr("x", "y").alias("correlation"),
        F.stddev_samp("y").alias("spread"), F.count("*").alias("n"),
    )


def effect_size(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Group means with their distance from the overall mean, in standard deviations of the
    values: a gap far below one is noise, however real the means are."""
    value = _value(df, metric)
    overall = df.filter(F.col(quoted(group)).isNotNull()).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread")
    ).first()
    centre, spread = overall["mean"], overall["spread"]
    effect = (F.col("mean") - F.lit(centre)) / F.lit(spread) if spread else F.lit(None).cast("double")
    return (
        df.filter(F.col(quoted(group)).isNotNull())
        .groupBy(F.col(quoted(group)).alias("segment"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
        .withColumn("effect", effect)
    )


def bins(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Mean of `y` per bin of `x`, with the rows behind it: a bin of few rows says little."""
    binned = materialize(
        _pairs(df, x, y).groupBy((F.floor(F.col("x") / F.lit(float(width))) * F.lit(float(width))).alias("bin"))
        .agg(F.avg("y").alias("mean"), F.count("*").alias("n")), "bins"
    )
    rows = binned.agg(F.sum("n")).first()[0] or 1
    return binned.withColumn("share", F.col("n") / F.lit(float(rows)))
