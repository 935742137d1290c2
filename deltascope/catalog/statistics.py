"""Plain statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

import deltascope as ds
from deltascope.catalog import query, rounded, table
from deltascope.catalog.tables import MESSY, messy_orders


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def corr_qty_price(spark, folder):
    return rounded(ds.correlation(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), 6, ["correlation"])


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10")
def topk_customers(spark, folder):
    return rounded(ds.topk_total(table(spark, folder, "orders"), "o_custkey", "o_totalprice", 10), 2, ["total"])


@query(f"WITH {MESSY} SELECT count(DISTINCT lower(trim(priority))) AS distinct_values FROM messy WHERE lower(trim(priority)) NOT IN ('n/a', '-')")
def distinct_priorities(spark, folder):
    return ds.distinct_values(messy_orders(spark, folder), "priority")


@query("SELECT count(DISTINCT lower(trim(o_orderstatus))) AS distinct_values FROM orders")
def distinct_statuses(spark, folder):
    return ds.distinct_values(table(spark, folder, "orders"), "o_orderstatus")


@query("SELECT round(avg(l_quantity), 6) AS mean FROM lineitem")
def mean_quantity(spark, folder):
    return rounded(ds.mean(table(spark, folder, "lineitem"), "l_quantity"), 6, ["mean"])


@query("SELECT round(median(l_extendedprice), 4) AS median FROM lineitem")
def median_price(spark, folder):
    return rounded(ds.median(table(spark, folder, "lineitem"), "l_extendedprice"), 4, ["median"])


@query(f"WITH {MESSY} SELECT count(*) FILTER (finished IS NULL) AS null_count FROM messy")
def null_count(spark, folder):
    return ds.null_count(messy_orders(spark, folder), "finished")


@query(f"WITH {MESSY} SELECT count(*) FILTER (lower(trim(finished)) = 'yes') AS yes_count FROM messy")
def yes_count(spark, folder):
    return ds.yes_count(messy_orders(spark, folder), "finished")


@query("""SELECT count(*) FILTER (l_returnflag = 'R') AS matching, count(*) AS n, round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS pct FROM lineitem""")
def share_returned(spark, folder):
    return rounded(ds.share_of_rows(table(spark, folder, "lineitem"), F.col("l_returnflag") == "R"), 6, ["pct"])


@query("""WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, avg(o_totalprice) AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1),
  c AS (SELECT *, 100 * (m - lag(m) OVER (ORDER BY period)) / lag(m) OVER (ORDER BY period) AS mp, 100 * (s - lag(s) OVER (ORDER BY period)) / lag(s) OVER (ORDER BY period) AS sp FROM t)
SELECT period, round(m, 4) AS mean, round(s, 2) AS total, round(mp, 6) + 0.0 AS mean_pct_change, round(sp, 6) + 0.0 AS total_pct_change, coalesce(sign(mp) * sign(sp) < 0, false) AS opposite_signs FROM c""")
def mean_vs_sum_change(spark, folder):
    result = ds.mean_vs_sum_change(table(spark, folder, "orders"), "o_totalprice", "o_orderdate")
    return rounded(rounded(rounded(result, 4, ["mean"]), 2, ["total"]), 6, ["mean_pct_change", "total_pct_change"])


def _series_sql(metric: str) -> str:
    return f"""SELECT '{metric}' AS metric, strftime(t.start, '%Y-%m') AS period, round(t.total, 2) AS total, round(t.total - t.prev, 2) + 0.0 AS change,
  round(100 * (t.total - t.prev) / t.prev, 6) + 0.0 AS pct_change, round(t.total - y.total, 2) + 0.0 AS year_change, round(100 * (t.total - y.total) / y.total, 6) + 0.0 AS year_pct_change
FROM (SELECT *, lag(total) OVER (ORDER BY start) AS prev FROM (SELECT date_trunc('month', l_shipdate) AS start, sum({metric}) AS total FROM lineitem GROUP BY 1)) t
LEFT JOIN (SELECT date_trunc('month', l_shipdate) AS start, sum({metric}) AS total FROM lineitem GROUP BY 1) y ON y.start + INTERVAL 1 YEAR = t.start"""


@query(" UNION ALL ".join(_series_sql(m) for m in ("l_extendedprice", "l_quantity")))
def mom_yoy_series(spark, folder):
    result = ds.series(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"], "l_shipdate")
    return rounded(rounded(result, 2, ["total", "change", "year_change"]), 6, ["pct_change", "year_pct_change"])


@query("""WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS period, sum(value) AS total FROM events GROUP BY 1),
  z AS (SELECT *, (total - avg(total) OVER ()) / stddev_samp(total) OVER () AS z FROM t)
SELECT period, round(total, 2) AS total, round(z, 6) + 0.0 AS z, CAST(row_number() OVER (ORDER BY abs(z) DESC, period) AS INTEGER) AS rank, abs(z) >= 2 AS unusual FROM z""")
def outlier_days(spark, folder):
    return rounded(rounded(ds.outlier_periods(table(spark, folder, "events"), "value", "ts"), 2, ["total"]), 6, ["z"])


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(stddev_samp(l_extendedprice), 4) AS spread, count(*) AS n FROM lineitem""")
def slope(spark, folder):
    result = ds.slope(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(rounded(rounded(result, 2, ["intercept"]), 4, ["slope", "spread"]), 6, ["r2", "correlation"])


@query("""WITH o AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)
SELECT l_returnflag AS segment, count(*) AS n, round(avg(l_quantity), 6) AS mean, round((avg(l_quantity) - min(m)) / min(s), 6) + 0.0 AS effect FROM lineitem, o GROUP BY 1""")
def effect_of_return_flag(spark, folder):
    return rounded(ds.effect_size(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity"), 6, ["mean", "effect"])


@query("""SELECT floor(l_quantity / 7.0) * 7.0 AS bin, round(avg(l_discount), 6) AS mean, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1""")
def binned_discount(spark, folder):
    return rounded(ds.bins(table(spark, folder, "lineitem"), "l_quantity", "l_discount", 7), 6, ["mean", "share"])
