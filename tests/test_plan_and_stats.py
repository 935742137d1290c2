import pytest
from pyspark.sql import functions as F

import deltascope as ds
from deltascope import Plan, profile, resolve_plan, run_plan, summability_guard
from deltascope.operators.duplicates import count_duplicates, drop_duplicates
from deltascope.plans.question import judge_plan
from test_change import long_table


@pytest.fixture(scope="module")
def long(spark):
    df = long_table(spark)
    return df, profile(df, duplicates=False)


def wanted(**kwargs):
    return Plan(**{"metric": "Value", "date_column": "Year", "period_after": "2025", "dimensions": ("Industry",), **kwargs})


def test_plan_that_fits_is_left_alone(long):
    plan, warnings = resolve_plan(wanted(), long[1], long[0])
    assert plan == wanted() and warnings == []


@pytest.mark.parametrize("change,field,value,kind", [
    ({"filters": (("Industry", "Space mining"),)}, "filters", (), "filter_value"),
    ({"filters": (("colour", "red"), ("Units", "dollars"))}, "filters", (("Units", "dollars"),), "filter_column"),
    ({"dimensions": ("Units", "Industry"), "filters": (("Units", "dollars"),)}, "dimensions", ("Industry",), None),
    ({"dimensions": ("colour", "Units")}, "dimensions", ("Units",), "absent"),
    ({"dimensions": ("colour",)}, "dimensions", ("Variable_name", "Units", "Industry"), "all"),
    ({"metric": "profit"}, "metric", "Value", "replaced"),
    ({"date_column": "shipped"}, "date_column", "Year", "replaced"),
    ({"period_after": "last spring"}, "period_after", None, "period"),
    ({"period_after": "2024-11"}, "period_after", "2024-11", None),
    ({"period_after": ""}, "period_after", None, None),
])
def test_plan_that_does_not_fit(long, change, field, value, kind):
    plan, verdicts = judge_plan(wanted(**change), long[1], long[0])
    assert getattr(plan, field) == value
    assert kind in {v.kind for v in verdicts} if kind else not verdicts
    assert [v.sentence() for v in verdicts] == resolve_plan(wanted(**change), long[1], long[0])[1]


def test_plans_without_a_way_out(spark):
    prof = profile(spark.createDataFrame([("a", "b"), ("c", "d")], "x string, y string"), duplicates=False)
    with pytest.raises(ValueError, match="metric"):
        resolve_plan(Plan(), prof)
    with pytest.raises(ValueError, match="date"):
        resolve_plan(Plan(metric="x"), prof)


def test_too_granular_dimension_is_dropped(spark):
    df = spark.range(20_000).select(
        F.concat(F.lit("v"), F.col("id") % 2_000).alias("label"), (2023 + F.col("id") % 2).alias("Year"), F.lit(1.0).alias("value")
    )
    plan, warnings = resolve_plan(Plan("value", "Year", "2024", ("label",)), profile(df, duplicates=False), df)
    assert "label" not in plan.dimensions and any("own value: label (2,000 values)" in w for w in warnings)


def test_run_plan(long):
    analysis = run_plan(wanted(filters=(("Variable_name", "total income"),)), long[0])
    assert analysis.total_before == pytest.approx(1000)
    with pytest.raises(ValueError, match="leave an empty table"):
        run_plan(wanted(filters=(("Variable_name", "nothing"),)), long[0])


def test_summability(spark):
    df = spark.createDataFrame(
        [("Why did revenue drop?", "change_over_time"), ("How did AVERAGE time change?", "change_over_time"), ("meaningful change?", "change_over_time"),
         ("rank them", "other"), ("x", "nonsense")], "question string, proposed string",
    )
    assert [r["route"] for r in summability_guard(df, route="proposed").collect()] == ["change_over_time", "other", "change_over_time", "other", "other"]
    assert summability_guard(df).filter("reason like '%average%'").count() == 1


def numbers(spark):
    return spark.createDataFrame([(float(i % 5), 2.0 * (i % 5) + 1, f"g{i % 2}", " Yes " if i % 3 == 0 else "no", 2020 + i // 10) for i in range(30)],
                                 "x double, y double, g string, flag string, Year int")


def test_statistics(spark):
    df = numbers(spark)
    assert ds.correlation(df, "x", "y").first()["correlation"] == pytest.approx(1)
    line = ds.slope(df, "x", "y").first()
    assert (line["slope"], line["intercept"], line["r2"]) == pytest.approx((2, 1, 1))
    assert ds.mean(df, "x").first()[0] == 2 and ds.median(df, "x").first()[0] == 2
    assert ds.yes_count(df, "flag").first()[0] == 10 and ds.distinct_values(df, "g").first()[0] == 2
    assert ds.null_count(df.withColumn("x", F.when(F.col("x") > 0, F.col("x"))), "x").first()[0] == 6
    assert [r["g"] for r in ds.topk_total(df, "g", "x", 1).collect()] == ["g0"]
    assert ds.share_of_rows(df, F.col("g") == "g0").first()["pct"] == 50
    assert sum(r["n"] for r in ds.bins(df, "x", "y", 2).collect()) == 30
    effects = ds.effect_size(df, "g", "x").collect()
    assert sum(r["effect"] for r in effects) == pytest.approx(0, abs=1e-9)


def test_mean_and_sum_can_disagree(spark):
    df = spark.createDataFrame([(2023, 10.0)] * 10 + [(2024, 11.0)] * 5, "Year int, v double")
    last = ds.mean_vs_sum_change(df, "v", "Year").orderBy(F.desc("period")).first()
    assert last["mean_pct_change"] == pytest.approx(10) and last["total_pct_change"] == pytest.approx(-45) and last["opposite_signs"]


def test_series_and_outliers(spark):
    rows = [(f"{2024 + m // 12}-{m % 12 + 1:02d}-10", 100.0 + m, 1.0) for m in range(24)] + [("2025-12-20", 500.0, 0.0)]
    df = spark.createDataFrame(rows, "d string, v double, w double").withColumn("d", F.to_date("d"))
    found = {(r["metric"], r["period"]): r for r in ds.series(df, ["v", "w"], "d").collect()}
    assert found["v", "2025-01"]["change"] == 1 and found["v", "2025-01"]["year_change"] == 12
    assert found["v", "2024-05"]["year_change"] is None and found["w", "2025-03"]["pct_change"] == 0
    top = ds.outlier_periods(df, "v", "d", "M").filter("rank = 1").first()
    assert top["period"] == "2025-12" and top["unusual"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, None, "a"), (2, "b", "c")] * 50 + [(i, "z", "z") for i in range(3, 40)], "x int, y string, z string")
    assert count_duplicates(df) == 237 - 40
    assert sorted(map(tuple, drop_duplicates(df).collect()), key=str) == sorted(map(tuple, df.distinct().collect()), key=str)
    unique = df.distinct()
    assert count_duplicates(unique) == 0 and drop_duplicates(unique).count() == unique.count()
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "v double")
    assert count_duplicates(zeros) == 2 and drop_duplicates(zeros).count() == 2


def test_queries_are_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


@pytest.mark.parametrize("distinct", [50, 51])
def test_dimensions_at_the_limit(spark, distinct):
    """Fifty spellings are a dimension and fifty-one are not, wherever the values lie and however often they come."""
    values = [f"v{i % distinct}" for i in range(4000)]
    spread = spark.createDataFrame([(v, v.upper() + " ", "x") for v in sorted(values)] + [("v0", "V0", "y")] * 5000, "sorted string, spelled string, two string")
    expected = ["sorted", "spelled", "two"] if distinct == 50 else ["two"]
    for parts in (1, 7):
        assert ds.auto_dimensions(spread.repartition(parts), max_unique=50) == expected
    # all values in one task, and one more in another
    late = spread.coalesce(1).unionByName(spark.createDataFrame([("late", None, None)], spread.schema))
    assert ds.auto_dimensions(late, max_unique=50) == (["spelled", "two"] if distinct == 50 else ["two"])
