"""Checks on a change analysis. Each compares two quantities computed apart from each other,
so each can fail."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltascope.functions import fixed


@dataclass(frozen=True)
class Check:
    kind: str
    subject: str
    passed: bool
    value: float
    detail: str

    @property
    def name(self) -> str:
        return {
            "reconcile": f"contributions by '{self.subject}' add up to the total change",
            "recompute": "period totals agree with the raw rows",
            "concentrated": "one contributor accounts for enough of the change",
            "offsetting": "little moved against the change",
        }[self.kind]


def reconcile(subject: str, residual: float, delta: float, tolerance: float) -> Check:
    """Do the parts add up?"""
    passed = abs(residual) <= tolerance
    detail = f"adds up to {delta:,.2f}" if passed else f"{residual:,.2f} of {delta:,.2f} unexplained"
    return Check("reconcile", subject, passed, residual, detail)


def run_checks(analysis) -> list[Check]:
    found = []
    for dimension, row in analysis.dimension_summary.items() if analysis.dimensions else ():
        found.append(reconcile(dimension, analysis.residual(row["explained"]), analysis.delta, analysis.tolerance))
    if analysis.crossed:
        explained = analysis._crossed_segments.agg(F.sum("after") - F.sum("before")).first()[0]
        found.append(
            reconcile(analysis.intersection_name, analysis.residual(explained), analysis.delta, analysis.tolerance)
        )
    found.append(_recompute(analysis))
    if analysis.dimensions:
        found += _concentrated(analysis)
        found += _offsetting(analysis)
    return found


def _recompute(analysis) -> Check:
    raw = analysis.raw_totals()
    drift = abs(float(raw["before"]) - analysis.total_before) + abs(float(raw["after"]) - analysis.total_after)
    return Check("recompute", analysis.metric, drift <= analysis.tolerance, drift, f"off by {drift:,.4f}")


def _concentrated(analysis) -> list[Check]:
    leading = {d: row["leading"] for d, row in analysis.dimension_summary.items() if row["leading"] is not None}
    if not leading:
        return []
    top = max(leading, key=leading.get)
    share = abs(leading[top] / analysis.pct_change) if analysis.pct_change else 0.0
    passed = share >= fixed.CONCENTRATED_MIN_SHARE
    detail = f"the largest contributor accounts for {share:.0%} of the move"
    return [Check("concentrated", top, passed, share, detail if passed else f"{detail}: broad, not one segment")]


def _offsetting(analysis) -> list[Check]:
    """A small net change can be what is left of large movement both ways."""
    if not analysis.pct_change:
        return []
    worst = max(analysis.dimensions, key=analysis.counter_movement)
    undefined = math.isnan(analysis.pct_change)
    ratio = 0.0 if undefined else analysis.counter_movement(worst) / abs(analysis.pct_change)
    if ratio <= fixed.OFFSETTING_MAX_RATIO:
        return [Check("offsetting", worst, True, ratio, f"at most {ratio:.0%} of the net change moved the other way")]
    movers = analysis.counter_movers(worst, 2).collect()
    named = ", ".join(f"{m['segment']} {m['contribution_pp']:+.2f} pp" for m in movers)
    detail = (
        f"segments of '{worst}' that moved the other way come to {ratio:.0%} of the net"
        f" {analysis.pct_change:+.1f}% ({named}), so the net hides movement on both sides"
    )
    return [Check("offsetting", worst, False, ratio, detail)]


def checks_frame(spark: SparkSession, checks: list[Check]) -> DataFrame:
    return spark.createDataFrame(
        [(i, c.kind, c.subject, c.name, c.passed, float(c.value), c.detail) for i, c in enumerate(checks, 1)],
        "position int, kind string, subject string, check string, passed boolean, value double, detail string",
    )
