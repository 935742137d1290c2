"""Reading tables: delimited text, parquet, JSON."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deltascope.functions import fixed
from deltascope.functions.text import plain_number, quoted
from deltascope.sources.materialize import materialize, scratch
from deltascope.sources.records import JSON, csv_grammar, open_field, read_records

DELIMITERS = (",", ";", "\t", "|")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Read one table by its suffix."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    readers = {
        ".csv": scan_csv, ".tsv": scan_csv, ".txt": scan_csv,
        ".parquet": scan_parquet, ".json": scan_json, ".jsonl": scan_json,
    }
    if suffix not in readers:
        raise ValueError(f"Unsupported file type: {suffix}")
    return readers[suffix](spark, path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """`.jsonl` has one document per line. A `.json` document is an array of objects, or one
    object, laid out in any way; it is cut into lines by many tasks and written once."""
    if not path.rstrip("/").lower().endswith(".json"):
        return spark.read.json(path)
    # a raw line break cannot be part of a JSON string, so it is mere layout
    objects = read_records(spark, path, JSON).where(F.col("text").contains("{"))
    line = F.regexp_replace(F.concat(F.regexp_replace("text", r"\A[^{]*+", ""), F.lit("}")), r"[\r\n]+", " ")
    lines = scratch(spark, "json-lines")
    objects.select(line.alias("value")).write.text(lines)
    return spark.read.json(lines)


def scan_csv(
    spark: SparkSession, path: str, sep: str | None = None, infer_types: bool = True, multi_line: bool | None = None
) -> DataFrame:
    """Delimited text with a header line.

    Everything is read as text, the strings that stand for null become null, and a column
    whose remaining values are all plain numbers (or all true/false) is then read as such.

    Quoted fields may hold line breaks. Whether any does is found out unless `multi_line`
    says so; if so, the files are cut into records by many tasks and written once, and line
    breaks inside quotes stay as they are in the file.
    """
    if sep is None:
        sep = "\t" if path.lower().endswith(".tsv") else sniff_delimiter(spark, path)
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path, sep)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line}
    raw = spark.read.options(header=True, **options).csv(path)
    if multi_line:
        # of the reader itself only the header is used, which takes the first record
        names = raw.columns
        record = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
        cells = F.from_csv(record, ", ".join(f"c{i} string" for i in range(len(names))), options)
        rows = read_records(spark, path, csv_grammar(sep)).where(~F.col("first")).select(cells.alias("cells"))
        raw = materialize(rows.select("cells.*"), "csv-records").toDF(*names)
    raw = raw.toDF(*[name or f"Unnamed: {i}" for i, name in enumerate(_header(raw))])
    nulled = raw.select(*[_null_strings(F.col(quoted(c))).alias(c) for c in raw.columns])
    return _typed(nulled) if infer_types else nulled


def has_quoted_breaks(spark: SparkSession, path: str, sep: str) -> bool:
    """Does a line end inside quotes? While none does, every line begins outside."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return not lines.where(F.col("value").contains('"') & F.col("value").rlike(open_field(sep))).isEmpty()


def _header(raw: DataFrame) -> list[str]:
    """A nameless header cell is called `_cN` by the reader; name it like a spreadsheet does."""
    return [None if name == f"_c{i}" else name for i, name in enumerate(raw.columns)]


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that splits the header line into the most fields."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(DELIMITERS, key=line.count) if any(d in line for d in DELIMITERS) else ","


def _null_strings(column: Column) -> Column:
    return F.when(~column.isin(*fixed.CSV_NA_STRINGS), column)


def _typed(df: DataFrame) -> DataFrame:
    """One aggregate over all columns decides which of them hold only numbers."""
    checks = []
    for i, name in enumerate(df.columns):
        column = F.col(quoted(name))
        number = plain_number(column)
        checks += [
            F.count(column).alias(f"filled_{i}"),
            F.count(number).alias(f"numbers_{i}"),
            F.coalesce(F.bool_and(column.rlike(r"^[+-]?\d{1,18}$")), F.lit(False)).alias(f"whole_{i}"),
            F.coalesce(F.bool_and(column.isin("True", "False", "TRUE", "FALSE", "true", "false")), F.lit(False)).alias(f"flags_{i}"),
        ]
    if not checks:
        return df
    seen = df.agg(*checks).first()
    out = []
    for i, name in enumerate(df.columns):
        column = F.col(quoted(name))
        if seen[f"filled_{i}"] and seen[f"whole_{i}"]:
            column = column.cast("bigint")
        elif seen[f"filled_{i}"] and seen[f"filled_{i}"] == seen[f"numbers_{i}"]:
            column = plain_number(column)
        elif seen[f"flags_{i}"]:
            column = column.cast("boolean")
        out.append(column.alias(name))
    return df.select(*out)
