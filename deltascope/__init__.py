"""Explain why a metric moved, on tables of any size, with Spark."""

from deltascope.functions.text import clean_text, coerce_numeric, strip
from deltascope.functions.time import parse_dates, period_of
from deltascope.operators.audit import attempt_summary, audit_answers, extract_numbers
from deltascope.operators.change import ChangeAnalysis, analyze_change
from deltascope.operators.dimensions import auto_dimensions
from deltascope.operators.duplicates import count_duplicates, drop_duplicates
from deltascope.operators.facts import facts, facts_text
from deltascope.operators.filters import apply_filters
from deltascope.operators.normalize import merged_spellings, normalization_report, normalize_categorical
from deltascope.operators.periods import period_totals, trend
from deltascope.operators.prepare import prepare, quality_issues
from deltascope.operators.profile import profile
from deltascope.operators.report import eval_report
from deltascope.operators.roles import dimension_candidates, metric_candidates, time_axes, too_granular
from deltascope.operators.stats import (
    bins, correlation, distinct_values, effect_size, mean, mean_vs_sum_change, median, null_count,
    outlier_periods, series, share_of_rows, slope, topk_total, yes_count,
)
from deltascope.plans.question import Plan, resolve_plan, run_plan, summability_guard
from deltascope.session import get_session
from deltascope.sources import export_csv, preview, run_records, scan, write_run_records, write_snapshot

__all__ = [
    "ChangeAnalysis", "Plan", "analyze_change", "apply_filters", "attempt_summary", "audit_answers",
    "auto_dimensions", "bins", "clean_text", "coerce_numeric", "correlation", "count_duplicates",
    "dimension_candidates", "distinct_values", "drop_duplicates", "effect_size", "eval_report", "export_csv",
    "extract_numbers", "facts", "facts_text", "get_session", "mean", "mean_vs_sum_change", "median",
    "merged_spellings", "metric_candidates", "normalization_report", "normalize_categorical", "null_count",
    "outlier_periods", "parse_dates", "period_of", "period_totals", "prepare", "preview", "profile",
    "quality_issues", "resolve_plan", "run_plan", "run_records", "scan", "series", "share_of_rows", "slope",
    "strip", "summability_guard", "time_axes", "too_granular", "topk_total", "trend", "write_run_records",
    "write_snapshot", "yes_count",
]
