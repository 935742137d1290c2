"""Time the headline queries at `$BENCH_SF_DIR` on `local[$BENCH_CPUS]`; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from deltascope import (
    analyze_change, apply_filters, median, normalize_categorical, period_totals, prepare, profile, scan, series, topk_total,
)
from deltascope.catalog import audit, tables
from deltascope.operators.duplicates import count_duplicates
from deltascope.operators.report import score_by_model
from deltascope.session import get_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run_all(frame) -> None:
    """Compute every row of a frame without bringing them to the driver."""
    frame.write.format("noop").mode("overwrite").save()


def full_change(table, metric, date_column, dimensions, **kwargs) -> None:
    """Slices, intersection, headline and all checks of one change."""
    analysis = analyze_change(table, metric, date_column, dimensions=dimensions, **kwargs)
    analysis.slices.collect(), analysis.intersection.collect(), analysis.headline().collect(), analysis.checks


def main() -> None:
    spark = get_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def read(name):
        return scan(spark, f"{FOLDER}/{name}.parquet")

    orders, lineitem, events = read("orders"), read("lineitem"), read("events")
    status = ["o_orderstatus", "o_orderpriority"]
    flags = ["l_returnflag", "l_linestatus"]
    queries = {
        "change_orders_yearly": lambda: full_change(orders, "o_totalprice", "o_orderdate", status, freq="Y", period_after="2000"),
        "breakdown_lineitem_monthly": lambda: analyze_change(lineitem, "l_extendedprice", "l_shipdate", "2001-09", dimensions=flags).slices.collect(),
        "change_events_daily": lambda: full_change(events, "value", "ts", ["event_type", "user_id"], freq="D", period_after="2024-01-14"),
        "change_messy_orders": lambda: full_change(tables.messy_orders(spark, FOLDER), "o_totalprice", "o_orderdate", ["priority", "finished"], freq="Y", period_after="2000"),
        "period_totals_lineitem": lambda: period_totals(lineitem, "l_extendedprice", "l_shipdate").collect(),
        "profile_lineitem": lambda: profile(lineitem),
        "profile_orders": lambda: profile(orders),
        "prepare_messy_orders": lambda: run_all(prepare(tables.messy_orders(spark, FOLDER)).frame),
        "normalize_priority": lambda: run_all(normalize_categorical(tables.messy_orders(spark, FOLDER), "priority")[0]),
        "duplicates_lineitem": lambda: count_duplicates(lineitem),
        "filter_casefold": lambda: run_all(apply_filters(lineitem, [("l_returnflag", " r "), ("l_linestatus", "o")])),
        "median_price": lambda: median(lineitem, "l_extendedprice").collect(),
        "topk_customers": lambda: topk_total(orders, "o_custkey", "o_totalprice", 10).collect(),
        "mom_yoy_series": lambda: series(lineitem, ["l_extendedprice", "l_quantity"], "l_shipdate").collect(),
        "audit_results": lambda: run_all(audit.graded(spark, FOLDER)),
        "eval_scores": lambda: score_by_model(audit._results(spark, FOLDER), audit._runs(spark, FOLDER)).collect(),
    }
    # start the engine: one analysis and one profile of a small table, not timed
    full_change(orders.limit(1000), "o_totalprice", "o_orderdate", status, freq="Y")
    profile(orders.limit(1000))
    seconds = {}
    for name, run in queries.items():
        started = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total seconds, headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(FOLDER).name,
    }))


if __name__ == "__main__":
    main()
