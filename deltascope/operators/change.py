"""What accounts for the change of a summable metric between two periods.

The rows of the two periods are unpivoted over the dimensions and combined into one row per
spelling; that small table is what everything else is derived from. Slices of different
dimensions describe the same change in different ways and must never be added together.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, functions as F

from deltascope.functions import fixed
from deltascope.functions.text import as_text, category_key, strip
from deltascope.operators.dimensions import auto_dimensions
from deltascope.operators.normalize import describe, fold, merged_spellings, report, spelling_counts
from deltascope.operators.periods import amount, choose_periods, time_axis, valid_rows
from deltascope.sources.materialize import materialize

SLICE_COLUMNS = (
    "dimension", "segment", "before", "after", "change", "contribution_pp", "own_pct_change",
    "share_of_total_before", "share_of_change", "is_decoy",
)


def measure(segments: DataFrame, total_before: float, delta: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Segment sums of both periods to slices. Every division is guarded."""
    change = F.col("after") - F.col("before")
    base, moved = F.lit(float(total_before)), F.lit(float(delta))
    zero = F.lit(0.0)
    own = F.when(F.col("before") != 0, 100 * change / F.col("before")).otherwise(
        F.when(F.col("after") != 0, F.lit(math.inf)).otherwise(zero)
    )
    return (
        segments.withColumn("before", F.col("before").cast("double"))
        .withColumn("after", F.col("after").cast("double"))
        .withColumn("change", change)
        .withColumn("contribution_pp", 100 * F.col("change") / base if total_before else zero)
        .withColumn("own_pct_change", own)
        .withColumn("share_of_total_before", 100 * F.col("before") / base if total_before else zero)
        .withColumn("share_of_change", F.col("change") / moved if delta else zero)
        .withColumn(
            "is_decoy",
            (F.abs("own_pct_change") >= fixed.DECOY_MIN_OWN_PCT) & (F.abs("share_of_change") < fixed.DECOY_MAX_SHARE),
        )
        .select(*SLICE_COLUMNS, *keep)
    )


def by_size() -> list[Column]:
    """Largest contribution first, with a full tie-break."""
    return [F.desc(F.abs("contribution_pp")), F.asc("change"), F.asc("dimension"), F.asc("segment")]


class ChangeAnalysis:
    """The decomposition of one change. Frames are planned on use; scalars are known."""

    def __init__(self, df, metric, date_column, periods, dimensions, axis, tolerance):
        self.metric, self.date_column, self.axis = metric, date_column, axis
        self.dimensions = list(dimensions)
        self.period_before, self.period_after = periods.before, periods.after
        self.exact_delta = periods.total_after - periods.total_before
        self.total_before, self.total_after = float(periods.total_before), float(periods.total_after)
        self.delta = float(self.exact_delta)
        self.pct_change = 100 * self.delta / self.total_before if self.total_before else math.nan
        self.direction = -1 if self.delta < 0 else 1
        # double sums are only exact to about a part in 1e12, whatever order they ran in
        self.tolerance = max(tolerance, 1e-12 * max(abs(self.total_before), abs(self.total_after)))
        self._raw = df
        rows = valid_rows(df, metric, axis)
        self._pair = rows.filter(axis.within(self.period_before) | axis.within(self.period_after))
        self._stored: DataFrame | None = None
        self._stored_segments: DataFrame | None = None

    # ------------------------------------------------------------- building blocks

    def _sums(self) -> dict[str, Column]:
        value = amount(self._raw, self.metric)
        return {
            "before": F.when(self.axis.within(self.period_before), value),
            "after": F.when(self.axis.within(self.period_after), value),
        }

    @property
    def spellings(self) -> DataFrame:
        """`(dimension, spelling, rows, before, after)` over the rows of the two periods."""
        return self._stored if self._stored is not None else self._plan_spellings()

    def _plan_spellings(self) -> DataFrame:
        return spelling_counts(self._pair, self.dimensions, self._sums()).fillna(0, ["before", "after"])

    def _keep(self) -> None:
        """From here on several plans read spellings and segments, so write them once. Both
        hold no more rows than there are spellings, and joins on them know their size."""
        if self._stored is None:
            self._stored = materialize(self._plan_spellings(), "spellings")
            self._stored_segments = materialize(fold(self._stored, ("before", "after")), "segments")

    @property
    def segments(self) -> DataFrame:
        """`(dimension, key, segment, rows, before, after, spellings)`."""
        if self._stored_segments is not None:
            return self._stored_segments
        return fold(self.spellings, ("before", "after"))

    # ------------------------------------------------------------- the decomposition

    @property
    def totals(self) -> DataFrame:
        return self._raw.sparkSession.createDataFrame(
            [(self.metric, self.period_before, self.period_after, self.total_before, self.total_after,
              self.delta, self.pct_change)],
            "metric string, period_before string, period_after string, total_before double,"
            " total_after double, delta double, pct_change double",
        )

    @property
    def slices(self) -> DataFrame:
        """Every segment of every dimension, both periods aligned; a segment that exists in
        only one period counts as zero in the other."""
        return measure(self.segments, self.total_before, self.delta)

    @cached_property
    def dimension_summary(self) -> dict[str, Row]:
        """Per dimension: residual, largest contributions, counter-movement. One row each, so
        this comes to the driver, where the rest of the analysis is decided."""
        self._keep()
        along, against = F.col("change") * self.direction > 0, F.col("change") * self.direction < 0
        size = F.abs("contribution_pp")
        # the exact sums are kept next to the measures, so that decimals reconcile exactly
        segments = self.segments.withColumn("moved", F.col("after") - F.col("before"))
        summary = measure(segments, self.total_before, self.delta, ("moved",)).groupBy("dimension").agg(
            F.sum("moved").alias("explained"),
            F.max(size).alias("concentration"),
            F.max(F.when(along, size)).alias("leading"),
            F.coalesce(F.sum(F.when(against, size)), F.lit(0.0)).alias("counter_movement"),
        )
        found = {r["dimension"]: r for r in summary.collect()}
        return {d: found[d] for d in self.dimensions}

    def residual(self, explained) -> float:
        return float(self.exact_delta - explained)

    @property
    def crossed(self) -> tuple[str, str] | None:
        """The two most concentrated dimensions; equal ones in the order given."""
        if len(self.dimensions) < 2:
            return None
        ranked = sorted(self.dimensions, key=lambda d: -self.dimension_summary[d]["concentration"])
        return ranked[0], ranked[1]

    @property
    def intersection_name(self) -> str | None:
        return " x ".join(self.crossed) if self.crossed else None

    @cached_property
    def _crossed_segments(self) -> DataFrame | None:
        """Rows of the pair combined per pair of spellings, then per pair of categories.

        The grouping is on the two categories, not on their joined text. Labels are joined
        after both aggregations, from the table written before, so the optimizer knows their
        size.
        """
        if self.crossed is None:
            return None
        first, second = self.crossed
        combined = (
            self._pair.select(
                strip(as_text(self._raw, first)).alias("a"), strip(as_text(self._raw, second)).alias("b"),
                *[value.alias(name) for name, value in self._sums().items()],
            )
            .groupBy("a", "b").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
            .groupBy(category_key(F.col("a")).alias("key_a"), category_key(F.col("b")).alias("key_b"))
            .agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
            .fillna(0, ["before", "after"])
        )
        for side, dimension in (("a", first), ("b", second)):
            labels = self.segments.filter(F.col("dimension") == dimension).select(
                F.col("key").alias(f"key_{side}"), F.col("segment").alias(f"segment_{side}")
            )
            combined = combined.join(labels, f"key_{side}")
        planned = combined.select(
            F.lit(self.intersection_name).alias("dimension"),
            F.concat_ws(" x ", "segment_a", "segment_b").alias("segment"), "before", "after",
        )
        return materialize(planned, "intersection")

    @property
    def intersection(self) -> DataFrame | None:
        """Slices of the two most concentrated dimensions crossed; None with fewer than two."""
        if self.crossed is None:
            return None
        return measure(self._crossed_segments, self.total_before, self.delta)

    # ------------------------------------------------------------- rankings

    def _slices_of(self, dimension: str | None) -> DataFrame:
        """One dimension, or the most specific view there is."""
        if dimension is None:
            return self.intersection if self.crossed else self._slices_of(self.dimensions[0])
        if dimension == self.intersection_name:
            return self.intersection
        return self.slices.filter(F.col("dimension") == dimension)

    def _moving(self, slices: DataFrame, sign: int) -> DataFrame:
        return slices.filter(F.col("change") * (self.direction * sign) > 0)

    def ranked(self, dimension: str | None = None, n: int | None = None) -> DataFrame:
        """Slices that moved with the total, largest contribution first."""
        ordered = self._moving(self._slices_of(dimension), 1).orderBy(*by_size())
        return ordered if n is None else ordered.limit(n)

    def counter_movers(self, dimension: str | None = None, n: int | None = None) -> DataFrame:
        """Slices that moved against the total, largest contribution first."""
        ordered = self._moving(self._slices_of(dimension), -1).orderBy(*by_size())
        return ordered if n is None else ordered.limit(n)

    def leading(self, dimension: str | None = None) -> DataFrame:
        return self.ranked(dimension, 1)

    def concentration(self, dimension: str) -> float:
        return self.dimension_summary[dimension]["concentration"]

    def counter_movement(self, dimension: str) -> float:
        return self.dimension_summary[dimension]["counter_movement"]

    def top_contributors(self, n: int = 5) -> DataFrame:
        """Largest movers in the direction of the change over all single dimensions. Each row
        names its dimension; they overlap, so never add them up."""
        if not self.dimensions:
            return self._raw.sparkSession.createDataFrame([], _SLICE_SCHEMA)
        place = F.create_map(*[F.lit(x) for i, d in enumerate(self.dimensions) for x in (d, i)])
        order = (F.desc(F.abs("contribution_pp")), place[F.col("dimension")].asc(), F.asc("change"), F.asc("segment"))
        return self._moving(self.slices, 1).orderBy(*order).limit(n)

    def headline(self) -> DataFrame:
        """The single largest contributor, preferably a crossed one."""
        if self.crossed is None:
            return self.top_contributors(1)
        both = self.ranked(n=1).withColumn("preference", F.lit(0)).unionByName(
            self.top_contributors(1).withColumn("preference", F.lit(1))
        )
        return both.orderBy("preference").limit(1).drop("preference")

    def decoys(self, n: int = 3) -> DataFrame:
        """Crossed slices whose own percentage looks dramatic but explains little."""
        if self.crossed is None:
            return self._raw.sparkSession.createDataFrame([], _SLICE_SCHEMA)
        return self._moving(self.intersection, 1).filter("is_decoy").orderBy(*by_size()).limit(n)

    def contributions(self, n: int = 12) -> DataFrame:
        """The ranked slices a chart shows."""
        return self.ranked(n=n)

    def per_dimension(self) -> DataFrame:
        """Every dimension's slices rounded for display, with whether they add up."""
        adds_up = F.create_map(*[
            F.lit(x) for d in self.dimensions
            for x in (d, abs(self.residual(self.dimension_summary[d]["explained"])) <= self.tolerance)
        ])
        return self.slices.select(
            "dimension", "segment",
            *[F.round(c, 2).alias(c) for c in ("before", "after", "change", "contribution_pp")],
            F.round("own_pct_change", 1).alias("own_pct_change"),
            adds_up[F.col("dimension")].alias("reconciles"),
        )

    # ------------------------------------------------------------- what was folded

    @property
    def normalization(self) -> DataFrame:
        self._keep()
        return report(self.spellings)

    @property
    def merged(self) -> DataFrame:
        self._keep()
        return merged_spellings(self.spellings)

    @cached_property
    def notes(self) -> list[str]:
        if not self.dimensions:
            return []
        self._keep()
        return describe(self.spellings)

    # ------------------------------------------------------------- figures for an answer

    def facts(self, scope: str = "") -> DataFrame:
        from deltascope.operators.facts import facts

        return facts(self, scope)

    # ------------------------------------------------------------- verification

    @cached_property
    def checks(self):
        from deltascope.operators.checks import run_checks

        return run_checks(self)

    @property
    def checks_frame(self) -> DataFrame:
        from deltascope.operators.checks import checks_frame

        return checks_frame(self._raw.sparkSession, self.checks)

    @property
    def passed(self) -> bool:
        return all(c.passed for c in self.checks)

    def raw_totals(self) -> Row:
        """Both totals again, straight from the rows with a range on the raw column: no
        period labels, no grouping, no other step shared with the totals above."""
        raw, value = self._raw, amount(self._raw, self.metric)
        columns = [
            F.coalesce(F.sum(F.when(self.axis.within(label), F.nanvl(value, F.lit(None).cast("double"))
                                    if raw.schema[self.metric].dataType.typeName() in ("double", "float") else value)),
                       F.lit(0)).alias(name)
            for name, label in (("before", self.period_before), ("after", self.period_after))
        ]
        return raw.filter(self.axis.within(self.period_before) | self.axis.within(self.period_after)).agg(*columns).first()


_SLICE_SCHEMA = (
    "dimension string, segment string, before double, after double, change double, contribution_pp double,"
    " own_pct_change double, share_of_total_before double, share_of_change double, is_decoy boolean"
)


def analyze_change(
    df: DataFrame,
    metric: str,
    date_column: str,
    period_after: str | None = None,
    period_before: str | None = None,
    dimensions: list[str] | None = None,
    freq: str = "M",
    tolerance: float = fixed.RECONCILE_TOLERANCE,
) -> ChangeAnalysis:
    """Decompose the change of `metric` between two periods over `dimensions`.

    The later period defaults to the last one, the earlier to the nearest one before it, and
    the dimensions to all text columns with few values. `tolerance` is how far parts and
    total may differ, in units of the metric.
    """
    axis = time_axis(df, date_column, freq)
    periods = choose_periods(df, metric, axis, period_after, period_before)
    if not dimensions:
        dimensions = auto_dimensions(valid_rows(df, metric, axis), {metric, date_column})
    return ChangeAnalysis(df, metric, date_column, periods, dimensions, axis, tolerance)
