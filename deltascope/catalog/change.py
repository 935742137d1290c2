"""Change analysis: periods, breakdowns, intersection, checks, normalisation, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from deltascope import (
    Plan, analyze_change, apply_filters, auto_dimensions, coerce_numeric, normalize_categorical, normalization_report, parse_dates,
    period_totals, profile, resolve_plan, run_plan, summability_guard, trend,
)
from deltascope.catalog import query, rounded, table
from deltascope.catalog.profiling import COLUMNS, dtype_of, profile_sql
from deltascope.catalog.tables import MESSY, PARSED, messy_orders
from deltascope.functions import fixed
from deltascope.operators.dimensions import folded_counts
from deltascope.operators.filters import require_rows, values_present
from deltascope.operators.normalize import merged_spellings, spelling_counts
from deltascope.operators.periods import time_axis, valid_rows

ORDER_DIMENSIONS = ["o_orderstatus", "o_orderpriority"]
TOKENS = ", ".join("'" + t + "'" for t in fixed.NULL_TOKENS)


# ---------------------------------------------------------------- the same in SQL


def rows_sql(source: str, metric: str, column: str, before: tuple[str, str], after: tuple[str, str], dims: dict[str, str]) -> str:
    """CTE `pair`: rows of both periods with the amount of each side."""
    ranges = [f"({column} >= TIMESTAMP '{a}' AND {column} < TIMESTAMP '{b}')" for a, b in (before, after)]
    columns = "".join(f", trim(CAST({expr} AS VARCHAR)) AS {name}" for name, expr in dims.items())
    return (
        f"pair AS (SELECT CASE WHEN {ranges[0]} THEN {metric} ELSE 0 END AS b,"
        f" CASE WHEN {ranges[1]} THEN {metric} ELSE 0 END AS a{columns}"
        f" FROM {source} WHERE {metric} IS NOT NULL AND ({ranges[0]} OR {ranges[1]})),"
        " totals AS (SELECT sum(b) AS tb, sum(a) AS ta, sum(a) - sum(b) AS delta FROM pair)"
    )


def key_sql(spelling: str) -> str:
    return f"CASE WHEN {spelling} IS NULL OR lower({spelling}) IN ({TOKENS}) THEN '(missing)' ELSE lower({spelling}) END"


def segments_sql(dims: list[str]) -> str:
    """CTEs `labels` and `segments` over all dimensions."""
    long = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS spelling, b, a FROM pair" for d in dims)
    return (
        f"long_rows AS ({long}),"
        f" spellings AS (SELECT dimension, {key_sql('spelling')} AS key, spelling, count(*) AS n, sum(b) AS b, sum(a) AS a"
        " FROM long_rows GROUP BY ALL),"
        " labels AS (SELECT dimension, key, CASE WHEN key = '(missing)' THEN key ELSE spelling END AS segment FROM ("
        "SELECT *, row_number() OVER (PARTITION BY dimension, key ORDER BY n DESC, spelling) AS place FROM spellings) WHERE place = 1),"
        " segments AS (SELECT s.dimension, l.segment, s.key, sum(s.b) AS b, sum(s.a) AS a FROM spellings s"
        " JOIN labels l ON l.dimension = s.dimension AND l.key = s.key GROUP BY ALL)"
    )


def crossed_sql(first: str, second: str) -> str:
    return (
        f"crossed AS (SELECT '{first} x {second}' AS dimension, x.segment || ' x ' || y.segment AS segment, sum(b) AS b, sum(a) AS a"
        f" FROM pair JOIN labels x ON x.dimension = '{first}' AND x.key = {key_sql('pair.' + first)}"
        f" JOIN labels y ON y.dimension = '{second}' AND y.key = {key_sql('pair.' + second)} GROUP BY ALL)"
    )


MEASURES = """dimension, segment, b, a, a - b AS change, CASE WHEN tb <> 0 THEN 100 * (a - b) / tb ELSE 0 END AS pp,
  CASE WHEN b <> 0 THEN 100 * (a - b) / b WHEN a <> 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS own,
  CASE WHEN tb <> 0 THEN 100 * b / tb ELSE 0 END AS base_share,
  CASE WHEN delta <> 0 THEN (a - b) / delta ELSE 0 END AS move_share, delta"""

SHOWN = """dimension, segment, round(b, 2) AS "before", round(a, 2) AS "after", round(change, 2) + 0.0 AS change,
  round(pp, 6) + 0.0 AS contribution_pp, round(own, 6) + 0.0 AS own_pct_change, round(base_share, 6) AS share_of_total_before,
  round(move_share, 6) + 0.0 AS share_of_change, abs(own) >= 25 AND abs(move_share) < 0.1 AS is_decoy"""


def measured(source: str) -> str:
    return f"(SELECT {MEASURES} FROM {source}, totals)"


def shown(slices: DataFrame) -> DataFrame:
    slices = rounded(slices, 2, ["before", "after", "change"])
    return rounded(slices, 6, ["contribution_pp", "own_pct_change", "share_of_total_before", "share_of_change"])


YEARS = (("1999-01-01", "2000-01-01"), ("2000-01-01", "2001-01-01"))
MONTHS = (("1999-01-01", "1999-02-01"), ("1999-02-01", "1999-03-01"))
SOURCE = {d: d for d in ORDER_DIMENSIONS}


def order_pair(spark, folder, freq="Y"):
    periods = {"Y": ("1999", "2000"), "M": ("1999-01", "1999-02")}[freq]
    return analyze_change(
        table(spark, folder, "orders"), "o_totalprice", "o_orderdate", period_before=periods[0], period_after=periods[1],
        dimensions=ORDER_DIMENSIONS, freq=freq,
    )


def order_sql(ranges, crossed=None) -> str:
    parts = [rows_sql("orders", "o_totalprice", "o_orderdate", *ranges, SOURCE), segments_sql(ORDER_DIMENSIONS)]
    return ", ".join(parts + ([crossed_sql(*crossed)] if crossed else []))


def both_pairs(run):
    """One query for the yearly and the monthly pair."""
    def combined(spark, folder):
        frames = [run(order_pair(spark, folder, f)).withColumn("freq", F.lit(f)) for f in ("Y", "M")]
        return reduce(DataFrame.unionByName, frames)

    return combined


def both_sql(body) -> str:
    parts = [f"SELECT *, '{f}' AS freq FROM (WITH {order_sql(r)} {body})" for f, r in (("Y", YEARS), ("M", MONTHS))]
    return " UNION ALL ".join(parts)


# the more concentrated dimension comes first; which one that is follows from the data
def crossing(base: str, dims: list[str], select: str) -> str:
    """`select` over `crossed`, crossed in the order of concentration."""
    spread = (
        f"spread AS (SELECT dimension, max(abs(pp)) AS most FROM {measured('segments')} GROUP BY dimension),"
        " ordered AS (SELECT (SELECT most FROM spread WHERE dimension = '%s') >= (SELECT most FROM spread WHERE dimension = '%s') AS given)"
        % (dims[0], dims[1])
    )
    return (
        f"WITH {base}, {spread}, {crossed_sql(*dims).replace('crossed AS', 'ab AS')},"
        f" {crossed_sql(*reversed(dims)).replace('crossed AS', 'ba AS')},"
        " crossed AS (SELECT * FROM ab WHERE (SELECT given FROM ordered) UNION ALL SELECT * FROM ba WHERE NOT (SELECT given FROM ordered))"
        f" {select}"
    )


def crossing_sql(ranges, select: str) -> str:
    return crossing(order_sql(ranges), ORDER_DIMENSIONS, select)


# ---------------------------------------------------------------- breakdowns

query(both_sql(f"SELECT {SHOWN} FROM {measured('segments')}"), "change_orders_by_dim")(both_pairs(lambda a: shown(a.slices)))

query(
    " UNION ALL ".join(
        f"SELECT *, '{f}' AS freq FROM ({crossing_sql(r, f'SELECT {SHOWN} FROM ' + measured('crossed'))})" for f, r in (("Y", YEARS), ("M", MONTHS))
    ),
    "change_orders_intersection",
)(both_pairs(lambda a: shown(a.intersection)))


def _ranked(a):
    frames = [a.ranked(d, n=12) for d in [*a.dimensions, a.intersection_name]]
    return shown(reduce(DataFrame.unionByName, frames))


RANK = "row_number() OVER (PARTITION BY dimension ORDER BY abs(pp) DESC, change, segment)"
ALL_SLICES = f"(SELECT * FROM {measured('segments')} UNION ALL SELECT * FROM {measured('crossed')})"

query(
    " UNION ALL ".join(
        f"SELECT *, '{f}' AS freq FROM ("
        + crossing_sql(r, f"SELECT {SHOWN} FROM (SELECT *, {RANK} AS place FROM {ALL_SLICES} WHERE change * sign(delta) > 0) WHERE place <= 12")
        + ")" for f, r in (("Y", YEARS), ("M", MONTHS))
    ),
    "change_orders_ranked",
)(both_pairs(_ranked))

query(
    " UNION ALL ".join(
        f"SELECT *, '{f}' AS freq FROM ("
        + crossing_sql(r, f"SELECT {SHOWN} FROM (SELECT *, {RANK} AS place FROM {ALL_SLICES} WHERE change * sign(delta) > 0) WHERE place = 1")
        + ")" for f, r in (("Y", YEARS), ("M", MONTHS))
    ),
    "change_orders_leading",
)(both_pairs(lambda a: shown(reduce(DataFrame.unionByName, [a.leading(d) for d in [*a.dimensions, a.intersection_name]]))))

query(both_sql(f"SELECT {SHOWN} FROM {measured('segments')} WHERE change * sign(delta) < 0"), "change_orders_counter_movers")(
    both_pairs(lambda a: shown(reduce(DataFrame.unionByName, [a.counter_movers(d) for d in a.dimensions])))
)

query(
    " UNION ALL ".join(
        f"SELECT *, '{f}' AS freq FROM ({crossing_sql(r, 'SELECT dimension, segment, round(own, 6) AS own_pct_change, round(move_share, 6) + 0.0 AS share_of_change, abs(own) >= 25 AND abs(move_share) < 0.1 AS is_decoy, change * sign(delta) > 0 AS moves_with FROM ' + measured('crossed'))})"
        for f, r in (("Y", YEARS), ("M", MONTHS))
    ),
    "change_orders_decoys",
)(both_pairs(
    lambda a: rounded(a.intersection, 6, ["own_pct_change", "share_of_change"]).select(
        "dimension", "segment", "own_pct_change", "share_of_change", "is_decoy",
        (F.col("change") * a.direction > 0).alias("moves_with"),
    )
))

query(
    " UNION ALL ".join(
        f"SELECT *, '{f}' AS freq FROM ("
        + crossing_sql(r, f"SELECT dimension, segment, round(pp, 6) AS contribution_pp FROM {measured('crossed')} WHERE change * sign(delta) > 0 AND abs(own) >= 25 AND abs(move_share) < 0.1 ORDER BY abs(pp) DESC, change, segment LIMIT 3")
        + ")" for f, r in (("Y", YEARS), ("M", MONTHS))
    ),
    "change_orders_decoy_list",
)(both_pairs(lambda a: rounded(a.decoys(), 6, ["contribution_pp"]).select("dimension", "segment", "contribution_pp")))

query(
    both_sql(f"SELECT dimension, segment, round(pp, 6) AS contribution_pp FROM {measured('segments')} WHERE change * sign(delta) > 0 ORDER BY abs(pp) DESC LIMIT 5"),
    "change_orders_top_contributors",
)(both_pairs(lambda a: rounded(a.top_contributors(5), 6, ["contribution_pp"]).select("dimension", "segment", "contribution_pp")))

query(
    " UNION ALL ".join(
        f"SELECT *, '{f}' AS freq FROM ("
        + crossing_sql(r, f"SELECT {SHOWN} FROM {measured('crossed')} WHERE change * sign(delta) > 0 ORDER BY abs(pp) DESC LIMIT 1")
        + ")" for f, r in (("Y", YEARS), ("M", MONTHS))
    ),
    "change_orders_headline",
)(both_pairs(lambda a: shown(a.headline())))

query(
    both_sql(
        "SELECT dimension, segment, round(b, 2) AS \"before\", round(a, 2) AS \"after\", round(change, 2) + 0.0 AS change, round(pp, 2) + 0.0 AS contribution_pp,"
        " round(own, 1) + 0.0 AS own_pct_change, abs(sum(change) OVER (PARTITION BY dimension) - delta) <= 0.01 AS reconciles"
        f" FROM {measured('segments')}"
    ),
    "change_orders_report",
)(both_pairs(lambda a: rounded(a.per_dimension(), 2, ["before", "after", "change", "contribution_pp", "own_pct_change"])))

query(both_sql("SELECT round(tb, 2) AS total_before, round(ta, 2) AS total_after, round(delta, 2) AS delta, round(100 * delta / tb, 6) AS pct_change FROM totals"), "change_orders_totals")(
    both_pairs(lambda a: rounded(rounded(a.totals, 2, ["total_before", "total_after", "delta"]), 6, ["pct_change"]).select("total_before", "total_after", "delta", "pct_change"))
)


def _drift_sql(ranges) -> str:
    """How far the totals are from those of the rows by their period's name, not by a range."""
    named = "strftime(o_orderdate, '%Y')" if ranges is YEARS else "strftime(o_orderdate, '%Y-%m')"
    before, after = (first[:4] if ranges is YEARS else first[:7] for first, _ in ranges)
    raw = ", ".join(f"sum(o_totalprice) FILTER ({named} = '{p}') AS {n}" for n, p in (("rb", before), ("ra", after)))
    return f"SELECT abs(rb - tb) + abs(ra - ta) AS drift FROM (SELECT {raw} FROM orders), totals"


def _checks_sql(ranges) -> str:
    against = f"SELECT dimension, coalesce(sum(CASE WHEN change * sign(delta) < 0 THEN abs(pp) END), 0) AS counter FROM {measured('segments')} GROUP BY dimension"
    top = f"SELECT dimension, abs(pp) AS pp FROM {measured('segments')} WHERE change * sign(delta) > 0 ORDER BY abs(pp) DESC LIMIT 1"
    ratio = "counter / abs(100 * delta / tb)"
    return crossing_sql(
        ranges,
        f"SELECT 'reconcile' AS kind, dimension AS subject, abs(min(delta) - sum(change)) <= 0.01 AS passed, 0.0 AS value FROM {ALL_SLICES} GROUP BY dimension"
        f" UNION ALL SELECT 'recompute', 'o_totalprice', drift <= 0.01, round(drift, 2) FROM ({_drift_sql(ranges)})"
        f" UNION ALL SELECT 'concentrated', dimension, pp / abs(100 * delta / tb) >= 0.35, round(pp / abs(100 * delta / tb), 6) FROM ({top}), totals"
        f" UNION ALL SELECT 'offsetting', dimension, {ratio} <= 0.5, round({ratio}, 6) FROM (SELECT * FROM ({against}) ORDER BY counter DESC LIMIT 1), totals",
    )


def _checks(a):
    frame = a.checks_frame.select("kind", "subject", "passed", "value")
    return frame.withColumn("value", F.when(F.col("kind").isin("reconcile", "recompute"), F.round("value", 2) + 0.0).otherwise(F.round("value", 6)))


query(
    " UNION ALL ".join(f"SELECT *, '{f}' AS freq FROM ({_checks_sql(r)})" for f, r in (("Y", YEARS), ("M", MONTHS))),
    "change_orders_checks",
)(both_pairs(_checks))


query(
    both_sql(
        "SELECT dimension, round(min(delta) - sum(change), 2) + 0.0 AS residual, round(max(abs(pp)), 6) AS concentration,"
        f" round(coalesce(sum(CASE WHEN change * sign(delta) < 0 THEN abs(pp) END), 0), 6) AS counter_movement FROM {measured('segments')} GROUP BY dimension"
    ),
    "change_orders_summary",
)(both_pairs(
    lambda a: rounded(
        rounded(
            a._raw.sparkSession.createDataFrame(
                [(d, a.residual(r["explained"]), a.concentration(d), a.counter_movement(d)) for d, r in a.dimension_summary.items()],
                "dimension string, residual double, concentration double, counter_movement double",
            ), 2, ["residual"],
        ), 6, ["concentration", "counter_movement"],
    )
))

query(
    " UNION ALL ".join(f"SELECT bool_and(passed) AS passed, '{f}' AS freq FROM ({_checks_sql(r)})" for f, r in (("Y", YEARS), ("M", MONTHS))),
    "change_orders_passed",
)(both_pairs(lambda a: a._raw.sparkSession.createDataFrame([(a.passed,)], "passed boolean")))


def facts_sql(base: str, dims: list[str], periods: tuple[str, str]) -> str:
    """All sections of the fact table with their texts."""
    spans = f"SELECT *, {RANK} AS place FROM {{}} WHERE change * sign(delta) > 0"
    figures = "dimension, segment, round(pp, 6) AS contribution_pp, round(own, 6) AS own_pct_change, round(base_share, 6) AS share_of_total_before"
    none = "NULL::VARCHAR AS dimension, NULL::VARCHAR AS segment, NULL::DOUBLE AS contribution_pp, NULL::DOUBLE AS own_pct_change, NULL::DOUBLE AS share_of_total_before"
    pct, counter = "100 * delta / tb", "coalesce(sum(CASE WHEN change * sign(delta) < 0 THEN abs(pp) END), 0)"
    crossed, segments = measured("crossed"), measured("segments")
    return crossing(base, dims, f"""
    SELECT 'total' AS section, 1 AS rank, {none}, format('o_totalprice {{}} from {{:,.2f}} in {periods[0]} to {{:,.2f}} in {periods[1]}, a change of {{:,.2f}} (',
        CASE WHEN delta < 0 THEN 'fell' ELSE 'rose' END, tb, ta, delta) || printf('%+.1f%%)', {pct}) AS text FROM totals
    UNION ALL SELECT 'headline', 1, {figures}, segment || ' (' || dimension || printf('): %+.2f percentage points of the %+.1f%% change; its own change was %+.1f%% and it made up %.1f%% of the starting total',
        pp, {pct}, own, base_share) FROM (SELECT * FROM ({spans.format(crossed)}) WHERE place = 1), (SELECT tb FROM totals)
    UNION ALL SELECT 'supporting', (place - 1)::INT, {figures}, segment || printf(': %+.2f pp (own change %+.1f%%)', pp, own) FROM ({spans.format(crossed)}) WHERE place IN (2, 3)
    UNION ALL SELECT 'alternative_view', place::INT, {figures}, 'by ' || dimension || ': ' || segment || printf(' %+.2f pp; overlaps with the headline', pp)
        FROM (SELECT *, row_number() OVER (ORDER BY abs(pp) DESC) AS place FROM {segments} WHERE change * sign(delta) > 0) WHERE place <= 3
    UNION ALL SELECT 'decoy', 1, {figures}, segment || printf(' moved %+.1f%% on its own but accounts for only %+.2f pp of the %+.1f%% change: it was %.1f%% of the starting o_totalprice',
        own, pp, {pct}, base_share) FROM (SELECT * FROM {crossed} WHERE change * sign(delta) > 0 AND abs(own) >= 25 AND abs(move_share) < 0.1
            ORDER BY abs(pp) DESC, change, segment LIMIT 1), (SELECT tb FROM totals)
    UNION ALL SELECT 'failed_check', (row_number() OVER (ORDER BY o))::INT, {none}, text FROM (
        SELECT 1 AS o, printf('one contributor accounts for enough of the change: the largest contributor accounts for %.0f%% of the move: broad, not one segment', 100 * share) AS text
        FROM (SELECT max(abs(pp)) / max(abs({pct})) AS share FROM {segments}, (SELECT tb FROM totals) WHERE change * sign(delta) > 0) WHERE share < 0.35
        UNION ALL SELECT 2, 'little moved against the change: segments of ''' || dimension || printf(''' that moved the other way come to %.0f%% of the net %+.1f%% (', 100 * ratio, pct)
            || (SELECT string_agg(segment || printf(' %+.2f pp', pp), ', ' ORDER BY place) FROM (SELECT *, {RANK} AS place FROM {segments} WHERE change * sign(delta) < 0) z
                WHERE z.dimension = w.dimension AND place <= 2) || '), so the net hides movement on both sides'
        FROM (SELECT dimension, {counter} / max(abs({pct})) AS ratio, max({pct}) AS pct FROM {segments}, (SELECT tb FROM totals) GROUP BY dimension ORDER BY ratio DESC LIMIT 1) w WHERE ratio > 0.5)""")


def _facts(a) -> DataFrame:
    return rounded(a.facts().drop("position"), 6, ["contribution_pp", "own_pct_change", "share_of_total_before"])


query(facts_sql(order_sql(YEARS), ORDER_DIMENSIONS, ("1999", "2000")), "change_orders_facts")(lambda spark, folder: _facts(order_pair(spark, folder)))

# many small groups: some of their crossings move a lot on their own and explain little
GROUPED = {"o_orderpriority": "o_orderpriority", "grp": "'g' || (o_custkey % 13)"}


def grouped_pair(spark, folder):
    orders = table(spark, folder, "orders").withColumn("grp", F.concat(F.lit("g"), (F.col("o_custkey") % 13).cast("string")))
    return analyze_change(orders, "o_totalprice", "o_orderdate", "1999-02", "1999-01", list(GROUPED))


GROUPED_BASE = f"{rows_sql('orders', 'o_totalprice', 'o_orderdate', *MONTHS, GROUPED)}, {segments_sql(list(GROUPED))}"
query(facts_sql(GROUPED_BASE, list(GROUPED), ("1999-01", "1999-02")), "change_grouped_facts")(lambda spark, folder: _facts(grouped_pair(spark, folder)))

query(
    crossing(GROUPED_BASE, list(GROUPED), "SELECT dimension, segment, round(pp, 6) AS contribution_pp, round(own, 6) AS own_pct_change FROM " + measured("crossed")
             + " WHERE change * sign(delta) > 0 AND abs(own) >= 25 AND abs(move_share) < 0.1 ORDER BY abs(pp) DESC, change, segment LIMIT 3"),
    "change_grouped_decoys",
)(lambda spark, folder: rounded(grouped_pair(spark, folder).decoys(), 6, ["contribution_pp", "own_pct_change"]).select("dimension", "segment", "contribution_pp", "own_pct_change"))


LINE = {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}


@query(f"WITH {rows_sql('lineitem', 'l_extendedprice', 'l_shipdate', ('2001-08-01', '2001-09-01'), ('2001-09-01', '2001-10-01'), LINE)},"
       f" {segments_sql(list(LINE))} SELECT {SHOWN} FROM {measured('segments')}")
def change_lineitem_monthly(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return shown(analyze_change(lineitem, "l_extendedprice", "l_shipdate", "2001-09", dimensions=list(LINE)).slices)


EVENT = {"event_type": "event_type", "user_group": "user_id % 10"}


@query(f"WITH {rows_sql('events', 'value', 'ts', ('2024-01-13', '2024-01-14'), ('2024-01-14', '2024-01-15'), EVENT)},"
       f" {segments_sql(list(EVENT))} SELECT {SHOWN} FROM {measured('segments')}")
def change_events_daily(spark, folder):
    events = table(spark, folder, "events").withColumn("user_group", F.col("user_id") % 10)
    return shown(analyze_change(events, "value", "ts", "2024-01-14", dimensions=list(EVENT), freq="D").slices)


@query(f"WITH {MESSY}, {rows_sql('messy', 'o_totalprice', 'o_orderdate', *YEARS, {'priority': 'priority', 'finished': 'finished'})},"
       f" {segments_sql(['priority', 'finished'])}, {crossed_sql('priority', 'finished').replace('crossed AS', 'ab AS')},"
       f" {crossed_sql('finished', 'priority').replace('crossed AS', 'ba AS')},"
       f" spread AS (SELECT dimension, max(abs(pp)) AS most FROM {measured('segments')} GROUP BY dimension),"
       " given AS (SELECT (SELECT most FROM spread WHERE dimension = 'priority') >= (SELECT most FROM spread WHERE dimension = 'finished') AS yes),"
       " crossed AS (SELECT * FROM ab WHERE (SELECT yes FROM given) UNION ALL SELECT * FROM ba WHERE NOT (SELECT yes FROM given))"
       f" SELECT {SHOWN} FROM {ALL_SLICES}")
def change_messy_orders(spark, folder):
    """Spelling variants and missing values folded before grouping, crossed as well."""
    a = analyze_change(messy_orders(spark, folder), "o_totalprice", "o_orderdate", "2000", "1999", ["priority", "finished"], "Y")
    return shown(a.slices.unionByName(a.intersection))


# ---------------------------------------------------------------- periods


@query("""WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS total FROM orders GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS place FROM t)
SELECT x.period AS period_before, y.period AS period_after, round(x.total, 2) AS total_before, round(y.total, 2) AS total_after
FROM r x JOIN r y ON x.place = 2 AND y.place = 1""")
def change_orders_default_periods(spark, folder):
    a = analyze_change(table(spark, folder, "orders"), "o_totalprice", "o_orderdate", dimensions=ORDER_DIMENSIONS)
    return rounded(a.totals, 2, ["total_before", "total_after"]).select("period_before", "period_after", "total_before", "total_after")


@query(f"WITH {PARSED} SELECT count(*) AS n, round(sum(amount), 2) AS total, count(*) FILTER (year(parsed_day) IN (1999, 2000)) AS pair_rows FROM parsed"
       " WHERE amount IS NOT NULL AND parsed_day IS NOT NULL")
def valid_rows_messy(spark, folder):
    """Rows with both a date and an amount, and those of two compared years."""
    messy = messy_orders(spark, folder)
    parsed = messy.withColumn("amount", coerce_numeric(F.col("price"))).withColumn("parsed_day", parse_dates(F.col("day")))
    axis = time_axis(parsed, "parsed_day", "Y")
    rows = valid_rows(parsed, "amount", axis)
    pair = F.count_if(axis.within("1999") | axis.within("2000")).alias("pair_rows")
    return rounded(rows.agg(F.count("*").alias("n"), F.sum("amount").alias("total"), pair), 2, ["total"])


FREQUENCY_LABELS = {
    "Y": "strftime(o_orderdate, '%Y')",
    "Q": "strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate)",
    "M": "strftime(o_orderdate, '%Y-%m')",
    "W": "strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' || strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d')",
    "D": "strftime(o_orderdate, '%Y-%m-%d')",
}


@query(" UNION ALL ".join(f"SELECT '{f}' AS freq, {label} AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL" for f, label in FREQUENCY_LABELS.items()))
def period_totals_orders(spark, folder):
    orders = table(spark, folder, "orders")
    frames = [period_totals(orders, "o_totalprice", "o_orderdate", f).withColumn("freq", F.lit(f)) for f in FREQUENCY_LABELS]
    return rounded(reduce(DataFrame.unionByName, frames), 2, ["total"])


# years and quarters that end elsewhere, weeks that end on another day, and parts of an hour
ANCHORED_LABELS = {
    "Y-JUN": "strftime(o_orderdate + INTERVAL 6 MONTH, '%Y')",
    "Q-JAN": "strftime(date_trunc('month', o_orderdate) + INTERVAL 11 MONTH, '%Y') || 'Q' || quarter(date_trunc('month', o_orderdate) + INTERVAL 11 MONTH)",
    "W-SAT": "strftime(o_orderdate - INTERVAL (dayofweek(o_orderdate)) DAY, '%Y-%m-%d') || '/' || strftime(o_orderdate + INTERVAL (6 - dayofweek(o_orderdate)) DAY, '%Y-%m-%d')",
}


@query(" UNION ALL ".join(f"SELECT '{f}' AS freq, {label} AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL" for f, label in ANCHORED_LABELS.items())
       + " UNION ALL SELECT '15min', strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M'), round(sum(value), 2) FROM events GROUP BY ALL")
def period_totals_anchored(spark, folder):
    orders, events = table(spark, folder, "orders"), table(spark, folder, "events")
    frames = [period_totals(orders, "o_totalprice", "o_orderdate", f).withColumn("freq", F.lit(f)) for f in ANCHORED_LABELS]
    frames.append(period_totals(events, "value", "ts", "15min").withColumn("freq", F.lit("15min")))
    return rounded(reduce(DataFrame.unionByName, frames), 2, ["total"])


@query(f"WITH {rows_sql('orders', 'o_totalprice', 'o_orderdate', ('1998-07-01', '1999-07-01'), ('1999-07-01', '2000-07-01'), SOURCE)},"
       f" {segments_sql(ORDER_DIMENSIONS)} SELECT {SHOWN} FROM {measured('segments')}")
def change_fiscal_years(spark, folder):
    orders = table(spark, folder, "orders")
    return shown(analyze_change(orders, "o_totalprice", "o_orderdate", "2000", dimensions=ORDER_DIMENSIONS, freq="Y-JUN").slices)


@query("SELECT strftime(ts, '%Y-%m-%d %H:00') AS period, round(sum(value), 2) AS total FROM events GROUP BY 1")
def period_totals_events_hourly(spark, folder):
    return rounded(period_totals(table(spark, folder, "events"), "value", "ts", "H"), 2, ["total"])


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def period_totals_year_axis(spark, folder):
    """A whole-number year, held as text, as the time axis."""
    orders = table(spark, folder, "orders").withColumn("fiscal_year", F.year("o_orderdate").cast("string"))
    return rounded(period_totals(orders, "o_totalprice", "fiscal_year"), 2, ["total"])


@query("SELECT strftime(l_shipdate, '%Y-%m') AS period, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def trend_lineitem(spark, folder):
    return rounded(trend(table(spark, folder, "lineitem"), "l_extendedprice", "l_shipdate"), 2, ["total"])


# ---------------------------------------------------------------- normalisation and filters

FOLDED = f"""{MESSY}, spelled AS (SELECT trim(priority) AS spelling, {key_sql('trim(priority)')} AS key, o_orderkey, o_totalprice FROM messy),
  counted AS (SELECT key, spelling, count(*) AS n FROM spelled GROUP BY ALL),
  labels AS (SELECT key, CASE WHEN key = '(missing)' THEN key ELSE spelling END AS segment FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, spelling) AS place FROM counted) WHERE place = 1)"""


@query(f"WITH {FOLDED} SELECT o_orderkey, segment AS priority FROM spelled JOIN labels USING (key)")
def normalize_priority(spark, folder):
    folded, _ = normalize_categorical(messy_orders(spark, folder), "priority")
    return folded.select("o_orderkey", "priority")


@query(f"""WITH {FOLDED} SELECT 'priority' AS dimension, (SELECT count(DISTINCT spelling) FROM spelled) AS raw_segments,
  (SELECT count(*) FROM labels) AS normalized_segments,
  (SELECT count(*) FROM (SELECT key FROM counted WHERE key <> '(missing)' GROUP BY key HAVING count(*) > 1)) AS merged_segments,
  (SELECT count(*) FROM spelled WHERE key = '(missing)') AS missing_rows""")
def normalize_report(spark, folder):
    return normalization_report(messy_orders(spark, folder), "priority")


@query(f"""WITH {FOLDED} SELECT 'priority' AS dimension, segment, spelling, n AS rows FROM counted JOIN labels USING (key)
WHERE key <> '(missing)' AND spelling <> segment""")
def normalize_merges(spark, folder):
    return merged_spellings(spelling_counts(messy_orders(spark, folder), ["priority"]))


@query(f"WITH {MESSY} SELECT o_orderkey, priority FROM messy WHERE lower(trim(priority)) = '5-low' AND lower(trim(finished)) = 'yes'")
def filter_casefold(spark, folder):
    return apply_filters(messy_orders(spark, folder), [("priority", " 5-Low "), ("finished", "yes")]).select("o_orderkey", "priority")


CANDIDATE_FILTERS = [("priority", "2-high"), ("priority", "no such priority"), ("finished", "NO"), ("o_custkey", "17")]


@query(f"WITH {MESSY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS filter_column, '{v}' AS filter_value, count(*) > 0 AS found FROM messy WHERE lower(trim(CAST({c} AS VARCHAR))) = '{v.strip().lower()}'"
    for c, v in CANDIDATE_FILTERS))
def filter_values_present(spark, folder):
    found = values_present(messy_orders(spark, folder), CANDIDATE_FILTERS)
    return spark.createDataFrame(
        [(c, v, f) for (c, v), f in zip(CANDIDATE_FILTERS, found)], "filter_column string, filter_value string, found boolean"
    )


GUARDED = [("o_orderpriority", "2-HIGH"), ("o_orderpriority", "none such"), ("o_orderstatus", "f"), ("o_custkey", "17")]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS filter_column, '{v}' AS filter_value, count(*) AS n FROM orders WHERE lower(trim(CAST({c} AS VARCHAR))) = '{v.lower()}'" for c, v in GUARDED))
def filter_empty_guard(spark, folder):
    """Rows that a filter leaves; a filter that leaves none is an error, counted as 0."""
    found = []
    for column, value in GUARDED:
        try:
            found.append((column, value, require_rows(table(spark, folder, "orders"), [(column, value)]).count()))
        except ValueError:
            found.append((column, value, 0))
    return spark.createDataFrame(found, "filter_column string, filter_value string, n bigint")


# ---------------------------------------------------------------- plans


@query(f"WITH {MESSY} SELECT dimension, n AS distinct_values FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, count(DISTINCT lower(trim({c}))) AS n FROM messy" for c in ("o_orderstatus", "priority", "price", "day", "finished")) + ") WHERE n BETWEEN 2 AND 50")
def auto_dimensions_orders(spark, folder):
    messy = messy_orders(spark, folder)
    return folded_counts(messy, auto_dimensions(messy, {"o_totalprice", "o_orderdate"}))


@query(f"WITH {rows_sql('(SELECT * FROM orders WHERE lower(trim(o_orderstatus)) = $$f$$)', 'o_totalprice', 'o_orderdate', ('1999-01-01', '1999-02-01'), ('1999-02-01', '1999-03-01'), {'o_orderpriority': 'o_orderpriority'})},"
       f" {segments_sql(['o_orderpriority'])} SELECT {SHOWN} FROM {measured('segments')}")
def plan_resolved_and_run(spark, folder):
    """A plan with an unknown metric, a dimension per entity, an unknown one, a filtered one
    and a filter on nothing: resolved against the profile, then run."""
    orders = table(spark, folder, "orders").select("o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    wanted = Plan(
        metric="turnover", date_column="o_orderdate", period_after="1999-02",
        dimensions=("o_orderpriority", "nowhere", "o_orderstatus"),
        filters=(("o_orderstatus", "f"), ("o_orderpriority", "none such"), ("nowhere", "x")),
    )
    plan, _ = resolve_plan(wanted, profile(orders, duplicates=False), orders)
    return shown(run_plan(plan, orders).slices)


ORDER_TYPES = {c: dtype_of(c) for c in COLUMNS["orders"]}
TAGGED = "tagged AS (SELECT *, 'tag ' || o_orderkey AS tag FROM orders),"
TAGGED_PROFILE = profile_sql("tagged", ORDER_TYPES | {"tag": "string"}, TAGGED)


@query(f"""SELECT 1 AS position, 'The table has no column ''turnover'' to serve as metric; ''' || name || ''' takes its place.' AS warning
  FROM (SELECT name FROM ({TAGGED_PROFILE}) WHERE semantic_type = 'numeric' ORDER BY regexp_matches(name, '{fixed.CODE_NAME_PATTERN}'), position LIMIT 1)
UNION ALL SELECT 2, 'The table has no column ''when'' to serve as date column; ''' || name || ''' takes its place.'
  FROM (SELECT name FROM ({TAGGED_PROFILE}) WHERE semantic_type = 'date' ORDER BY position LIMIT 1)
UNION ALL SELECT 3, 'Not in the table and left out of the grouping: nowhere.'
UNION ALL SELECT 4, 'Left out of the grouping, since almost every row has its own value: tag (' || format('{{:,}}', unique_count) || ' values).'
  FROM ({TAGGED_PROFILE}), (SELECT count(*) AS n FROM orders) WHERE name = 'tag' AND unique_count > {fixed.GRANULAR_MIN_DISTINCT} AND unique_count > {fixed.GRANULAR_MIN_RATIO} * n
UNION ALL SELECT 5, '''last spring'' is no period; the latest one is analysed.'
UNION ALL SELECT 6, 'The filter o_orderpriority = ''none such'' is dropped, no row has that value.' WHERE NOT EXISTS (SELECT * FROM orders WHERE lower(trim(o_orderpriority)) = 'none such')
UNION ALL SELECT 7, 'The filter o_orderstatus = ''f'' is dropped, no row has that value.' WHERE NOT EXISTS (SELECT * FROM orders WHERE lower(trim(o_orderstatus)) = 'f')
UNION ALL SELECT 8, 'The filter on ''nowhere'' is dropped, there is no such column.'
UNION ALL SELECT 9, 'grouped by ' || string_agg(name, ', ' ORDER BY position) FROM ({TAGGED_PROFILE}) WHERE name = 'o_orderpriority'""")
def plan_warnings(spark, folder):
    """A plan with an unknown metric and date, a column that names every row, an unknown one,
    and filters on nothing: every verdict as a sentence, and what is left of the grouping."""
    orders = table(spark, folder, "orders")
    tagged = orders.withColumn("tag", F.concat(F.lit("tag "), F.col("o_orderkey").cast("string")))
    wanted = Plan(
        metric="turnover", date_column="when", period_after="last spring", dimensions=("nowhere", "tag", "o_orderpriority", "o_orderstatus"),
        filters=(("o_orderpriority", "none such"), ("o_orderstatus", "f"), ("nowhere", "x")),
    )
    plan, warnings = resolve_plan(wanted, profile(tagged, duplicates=False), tagged)
    kinds = ("metric;", "date column;", "Not in", "Left out", "no period", "'none such'", "'f'", "'nowhere' is dropped")
    places = [next(i for i, k in enumerate(kinds, 1) if k in w) for w in warnings]
    rows = [*zip(places, warnings), (len(kinds) + 1, "grouped by " + ", ".join(plan.dimensions))]
    return spark.createDataFrame(rows, "position int, warning string")


WORDS = fixed.NOT_A_SUM_PATTERN


@query(f"""SELECT o_orderkey, CASE WHEN word <> '' THEN 'other' ELSE 'change_over_time' END AS route,
  CASE WHEN word <> '' THEN concat('asks for ', chr(39), lower(word), chr(39), ', which is not a sum') END AS reason FROM (
  SELECT o_orderkey, regexp_extract(question, '{WORDS}', 1) AS word FROM (
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Why did orders by ' || o_orderpriority || ' fall?'
      WHEN 1 THEN 'What is the Average price of ' || o_orderpriority || '?'
      WHEN 2 THEN 'How meaningful is status ' || o_orderstatus || '?'
      ELSE 'Standard deviation for customer ' || o_custkey END AS question FROM orders))""")
def summability_of_questions(spark, folder):
    key = F.col("o_orderkey") % 4
    question = (
        F.when(key == 0, F.concat(F.lit("Why did orders by "), "o_orderpriority", F.lit(" fall?")))
        .when(key == 1, F.concat(F.lit("What is the Average price of "), "o_orderpriority", F.lit("?")))
        .when(key == 2, F.concat(F.lit("How meaningful is status "), "o_orderstatus", F.lit("?")))
        .otherwise(F.concat(F.lit("Standard deviation for customer "), F.col("o_custkey").cast("string")))
    )
    questions = table(spark, folder, "orders").select("o_orderkey", question.alias("question"))
    return summability_guard(questions).select("o_orderkey", "route", "reason")
