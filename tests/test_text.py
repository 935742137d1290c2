"""Parsing and folding of messy text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from deltascope import clean_text, coerce_numeric, normalization_report, normalize_categorical, parse_dates, period_of, strip
from deltascope.functions.time import frequency, period_bounds
from deltascope.operators.normalize import describe, merged_spellings, spelling_counts


def mapped(spark, function, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_coerce_numeric(spark):
    texts = ["$1,234.56", "(500.00)", "12%", "  $7.00 ", "(-5)", "$(5)", "1.0d", "", None, "abc", "€3", "-4.5", "1e3", "(12%)", "1 234"]
    assert mapped(spark, coerce_numeric, texts) == [1234.56, -500.0, 0.12, 7.0, 5.0, 5.0, None, None, None, None, 3.0, -4.5, 1000.0, -0.12, 1234.0]


def test_strip_and_null_tokens(spark):
    assert mapped(spark, strip, ["\t a b  ", "", None]) == ["a b", "", None]
    assert mapped(spark, clean_text, [" N/A ", "TBD", "-", "#n/a", "Unknown", " x "]) == [None, "TBD", None, None, None, "x"]


def test_parse_dates(spark):
    day = dt.datetime(2026, 1, 15)
    texts = {
        "01/15/2026": day, "15/01/2026": day, "2026-01-15": day, "2026-1-15": day, "Jan 15, 2026": day, "15 January 2026": day,
        "20260115": day, "15.01.2026": day, "2026/1/15": day, " 2026-01-15 ": day,
        "2026-01-15T10:30:00Z": dt.datetime(2026, 1, 15, 10, 30), "2026-01-15 10:30": dt.datetime(2026, 1, 15, 10, 30),
        "2026-01-15T10:30:00.25+02:00": dt.datetime(2026, 1, 15, 8, 30, 0, 250000), "1/15/2026 4:05 PM": dt.datetime(2026, 1, 15, 16, 5),
        "02/03/2026": dt.datetime(2026, 2, 3), "2026-03": dt.datetime(2026, 3, 1),
        "2025": None, "13/13/2026": None, "soon": None, "": None,
    }
    assert mapped(spark, parse_dates, list(texts)) == list(texts.values())


@pytest.mark.parametrize("freq,label", [("Y", "2026"), ("Q", "2026Q1"), ("M", "2026-03"), ("W", "2026-03-16/2026-03-22"), ("D", "2026-03-18"), ("H", "2026-03-18 05:00")])
def test_labels_and_bounds_agree(spark, freq, label):
    moment = spark.createDataFrame([(dt.datetime(2026, 3, 18, 5, 7),)], "t timestamp")
    for kind in ("timestamp", "timestamp_ntz"):
        assert moment.select(period_of(F.col("t").cast(kind), freq)).first()[0] == label
    start, end = period_bounds(label, freq)
    assert start <= dt.datetime(2026, 3, 18, 5, 7) < end
    for instant, inside in ((start, True), (end, False), (end - dt.timedelta(microseconds=1), True)):
        row = spark.createDataFrame([(instant,)], "t timestamp").select(period_of(F.col("t"), freq)).first()
        assert (row[0] == label) is inside
    assert period_bounds("nonsense", freq) is None


@pytest.mark.parametrize("freq,named", [
    ("Y-JUN", "Y-JUN"), ("A-JAN", "Y-JAN"), ("Q-JAN", "Q-JAN"), ("Q-NOV", "Q-NOV"), ("Q-DEC", "Q"), ("W-SAT", "W-SAT"), ("W-SUN", "W"), ("W-WED", "W-WED"),
])
def test_anchored_calendars_agree_with_pandas(spark, freq, named):
    import pandas as pd

    assert frequency(freq) == named
    days = [dt.datetime(2019, 12, 20) + dt.timedelta(days=17 * i, hours=5) for i in range(60)]
    rows = spark.createDataFrame([(d,) for d in days], "t timestamp").select("t", period_of(F.col("t"), freq).alias("p")).collect()
    for r in rows:
        assert r.p == str(pd.Period(r.t, freq.replace("A-", "Y-")))
        start, end = period_bounds(r.p, freq)
        assert start <= r.t < end
        assert period_bounds(r.p, freq) == (pd.Period(r.t, freq.replace("A-", "Y-")).start_time, (pd.Period(r.t, freq.replace("A-", "Y-")) + 1).start_time)


@pytest.mark.parametrize("freq,label", [("15min", "2026-03-18 05:00"), ("2T", "2026-03-18 05:06"), ("6H", "2026-03-18 00:00"), ("30S", "2026-03-18 05:07:30")])
def test_parts_of_a_day(spark, freq, label):
    moment = dt.datetime(2026, 3, 18, 5, 7, 44)
    assert spark.createDataFrame([(moment,)], "t timestamp").select(period_of(F.col("t"), freq)).first()[0] == label
    start, end = period_bounds(label, freq)
    assert start <= moment < end and period_bounds("2026-03-18 05:01" if "S" not in freq else "2026-03-18 05:07:01", freq) is None


@pytest.mark.parametrize("freq", ["X", "2M", "Y-XXX", "W-JAN", "0H", "", "M-JAN"])
def test_unknown_frequencies(freq):
    with pytest.raises(ValueError, match="frequency"):
        frequency(freq)


def test_hot_categories_do_not_meet_in_one_task(spark):
    """Half of the rows without a value and a third of one category, labels not broadcast."""
    n = 12_000
    hot = F.when(F.col("id") % 6 < 3, F.lit(None)).when(F.col("id") % 6 < 5, F.when(F.col("id") % 2 == 0, "West").otherwise("west ")).otherwise(F.concat(F.lit("c"), F.col("id") % 50))
    df = spark.range(0, n, 1, 8).select("id", hot.alias("region"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        folded, _ = normalize_categorical(df, "region")
        sizes = [r["count"] for r in folded.groupBy(F.spark_partition_id()).count().collect()]
        found = {r.region: r["count"] for r in folded.groupBy("region").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) < 4 * n / 16
    assert found["(missing)"] == n / 2 and found["West"] + found.get("west", 0) == n / 3 and "west" not in found


def test_normalize(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["West", "west", " West ", "East", "N/A", None])], "i int, region string")
    folded, report = normalize_categorical(df, "region")
    assert [r["region"] for r in folded.orderBy("i").collect()] == ["West", "West", "West", "East", "(missing)", "(missing)"]
    assert folded.columns == df.columns
    row = report.first()
    assert (row["raw_segments"], row["normalized_segments"], row["merged_segments"], row["missing_rows"]) == (4, 3, 1, 2)
    assert normalization_report(df, "region").first() == row
    spellings = spelling_counts(df, ["region"])
    assert [tuple(r) for r in merged_spellings(spellings).collect()] == [("region", "West", "west", 1)]
    note = describe(spellings)[0]
    assert "West <- 'west'" in note and "2 rows" in note


def test_ties_go_to_the_smallest_spelling(spark):
    df = spark.createDataFrame([("b",), ("B",), ("c",)], "v string")
    assert {r["v"] for r in normalize_categorical(df, "v")[0].collect()} == {"B", "c"}
    assert describe(spelling_counts(df.filter("v = 'c'"), ["v"])) == []


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([("x", "1")], "`a.b c` string, v string")
    assert normalize_categorical(df, "a.b c")[0].first()["a.b c"] == "x"
