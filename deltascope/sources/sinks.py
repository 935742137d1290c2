"""Writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a prepared table as parquet, types kept, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Write as CSV with a header, one file per partition; blanks around values are kept."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options).csv(path)


def preview(df: DataFrame, n: int = 1000) -> DataFrame:
    """The first rows, for display."""
    return df.limit(n)


def run_records(runs: DataFrame, results: DataFrame) -> DataFrame:
    """One record per run with its failed assertions nested.

    The results of a run are as many as its case has assertions, so the nested list is small;
    counts are map-side combined before the shuffle.
    """
    key = ["case_id", "model", "attempt"]
    failure = F.struct("family", F.col("assertion").alias("name"), "detail")
    graded = results.groupBy(*key).agg(
        F.count_if("passed").alias("passed"),
        F.count("*").alias("total"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), failure))).alias("failures"),
    )
    return runs.join(graded, key, "left").select(
        F.col("case_id").alias("case"), "model", "attempt", "route",
        F.coalesce("passed", F.lit(0)).alias("passed"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.round("seconds", 2).alias("seconds"), "output_tokens", "error",
        F.coalesce("failures", F.array().cast(graded.schema["failures"].dataType)).alias("failures"),
        "narrative",
    )


def write_run_records(runs: DataFrame, results: DataFrame, path: str) -> None:
    run_records(runs, results).write.mode("overwrite").json(path)
