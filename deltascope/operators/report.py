"""Summaries over graded runs.

    results   case_id, model, attempt, family, assertion, passed
    runs      case_id, model, attempt, seconds, output_tokens, error
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deltascope.functions import fixed
from deltascope.operators.quantiles import group_medians

FAMILIES = ("routing", "interpretation", "correctness", "communication")


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, 100.0 * part / whole)


def _passed() -> Column:
    return F.count_if("passed")


def completed(results: DataFrame, runs: DataFrame) -> DataFrame:
    """The results of runs that did not end in an error; an errored run says nothing about answers."""
    run = ["case_id", "model", "attempt"]
    errored = runs.filter(F.col("error").isNotNull()).select(*run).distinct()
    return results.join(errored, run, "left_anti")


def _median_seconds(runs: DataFrame) -> DataFrame:
    """Exact median per model, however many models there are; none for a model without a completed run."""
    timed = runs.filter(F.col("error").isNull() & F.col("seconds").isNotNull())
    counts = timed.groupBy(F.col("model").alias("group"), F.col("seconds").cast("double").alias("value")).agg(F.count("*").alias("rows"))
    medians = group_medians(counts).withColumnRenamed("group", "_model")
    models = runs.select("model").distinct()
    return models.join(medians, models["model"].eqNullSafe(medians["_model"]), "left").select("model", F.col("median").alias("median_seconds"))


def score_by_model(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Assertions passed and median seconds per model, runs that ended in an error aside."""
    scores = completed(results, runs).groupBy("model").agg(_passed().alias("passed"), F.count("*").alias("total"))
    scores = scores.withColumnRenamed("model", "_model")
    timed = _median_seconds(runs)
    return timed.join(scores, timed["model"].eqNullSafe(scores["_model"]), "left").select(
        "model", "passed", "total", _pct(F.col("passed"), F.col("total")).alias("pct"), "median_seconds"
    )


def score_by_family(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Pass rate per model, one column per family, errored runs aside."""
    rate = F.avg(F.when(F.col("passed"), 100.0).otherwise(0.0))
    return completed(results, runs).groupBy("model").pivot("family", list(FAMILIES)).agg(rate)


def _per_run(results: DataFrame, runs: DataFrame) -> DataFrame:
    return completed(results, runs).groupBy("case_id", "model", "attempt").agg(_passed().alias("passed"), F.count("*").alias("total"))


def score_by_case(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Worst and best score of each case over its attempts, errored runs aside."""
    return _per_run(results, runs).groupBy("case_id", "model").agg(
        F.min("passed").alias("worst"), F.max("passed").alias("best"), F.max("total").alias("total"),
        F.count("*").alias("runs"),
    )


def run_variance(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Spread of the score over whole passes through the suite, errored runs aside; one pass has none."""
    passes = completed(results, runs).groupBy("model", "attempt").agg(_pct(_passed(), F.count("*")).alias("pct"))
    return passes.groupBy("model").agg(
        F.avg("pct").alias("mean_pct"), F.coalesce(F.stddev_samp("pct"), F.lit(0.0)).alias("sd"),
        F.min("pct").alias("worst_pct"), F.max("pct").alias("best_pct"), F.count("*").alias("passes"),
    )


def unstable_cases(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Cases that did not score the same in every attempt, errored runs aside."""
    return (
        _per_run(results, runs).groupBy("model", "case_id")
        .agg(F.min("passed").alias("worst"), F.max("passed").alias("best"))
        .filter("worst < best")
    )


def common_failures(results: DataFrame, n: int = 8) -> DataFrame:
    """The assertions that fail most often."""
    return (
        results.filter(~F.col("passed")).groupBy("family", "assertion").agg(F.count("*").alias("failures"))
        .orderBy(F.desc("failures"), "family", "assertion").limit(n)
    )


def gate(results: DataFrame, minimum: float = fixed.GATE_MIN_SCORE) -> DataFrame:
    """Is the overall score good enough?"""
    totals = results.agg(_passed().alias("passed"), F.count("*").alias("total"))
    score = F.col("passed") / F.greatest("total", F.lit(1))
    return totals.withColumn("score", score).withColumn("ok", F.col("score") >= minimum)


CALL_FIELDS = {"input_tokens": "bigint", "output_tokens": "bigint", "seconds": "double", "cost_usd": "double"}


def with_calls(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Runs with their calls nested as `calls`; a run without any has an empty list.

    Calls are `case_id, model, attempt` and the figures of `CALL_FIELDS`, of which any may be
    missing. The calls of one run are few, since a run is one answer.
    """
    key = ["case_id", "model", "attempt"]
    figures = [F.col(n).cast(t).alias(n) if n in calls.columns else F.lit(None).cast(t).alias(n) for n, t in CALL_FIELDS.items()]
    nested = calls.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.collect_list(F.struct(*figures)).alias("calls"))
    joined = runs.join(nested, [runs[k].eqNullSafe(nested[f"_{k}"]) for k in key], "left")
    empty = F.array().cast(nested.schema["calls"].dataType)
    return joined.withColumn("calls", F.coalesce("calls", empty)).drop(*[f"_{k}" for k in key])


def usage(runs: DataFrame) -> DataFrame:
    """Runs, calls, tokens, seconds, cost and speed per model.

    With a nested `calls` column, as `with_calls` makes it, every call counts; each run is
    added up by itself before anything moves. Without one a run is a call.
    """
    if "calls" in runs.columns:
        def total(name: str) -> Column:
            kind = CALL_FIELDS[name]
            return F.aggregate("calls", F.lit(0).cast(kind), lambda t, c: t + F.coalesce(c[name], F.lit(0).cast(kind)))

        figures = {"calls": F.size("calls").cast("bigint"), **{n: total(n) for n in CALL_FIELDS}}
    else:
        figures = {"calls": F.lit(1).cast("bigint")} | {
            n: F.col(n) if n in runs.columns else F.lit(0).cast(t) for n, t in CALL_FIELDS.items()
        }
    per_run = runs.select("model", *[value.alias(n) for n, value in figures.items()])
    return per_run.groupBy("model").agg(
        F.count("*").alias("runs"), *[F.sum(n).alias(n) for n in figures]
    ).withColumn(
        "tokens_per_second", F.when(F.col("seconds") != 0, F.col("output_tokens") / F.col("seconds")).otherwise(0.0)
    )


def usage_text(runs: DataFrame) -> DataFrame:
    """`(model, usage)`: one line a model."""
    c = F.col
    cost = F.when(c("cost_usd") > 0, F.format_string("$%.4f", "cost_usd")).otherwise("no cost")
    line = F.concat(
        F.format_number("calls", 0), F.lit(" call(s) in "), F.format_number("runs", 0), F.lit(" run(s), "),
        F.format_number(F.coalesce("output_tokens", F.lit(0)), 0), F.lit(" tokens out, "), F.format_string("%.1f s", F.coalesce("seconds", F.lit(0.0))), F.lit(", "), cost,
    )
    return usage(runs).select("model", F.when(c("calls") == 0, "no calls").otherwise(line).alias("usage"))


def eval_report(results: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    return {
        "scores": score_by_model(results, runs),
        "families": score_by_family(results, runs),
        "cases": score_by_case(results, runs),
        "variance": run_variance(results, runs),
        "unstable": unstable_cases(results, runs),
        "failures": common_failures(results),
        "gate": gate(results),
        "usage": usage(runs),
    }
