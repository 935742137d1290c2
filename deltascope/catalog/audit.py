"""Audits of written answers and reports on graded runs, over answers that Spark derives
from the orders: one answer per order, one graded assertion per line item."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from deltascope import attempt_summary, audit_answers, eval_report, run_records, write_run_records
from deltascope.catalog import query, rounded, table
from deltascope.functions import fixed
from deltascope.operators import audit as g
from deltascope.operators import report as r
from deltascope.sources.materialize import shared_folder


def answers(spark, folder) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    amount, customer = F.format_number("o_totalprice", 2), F.col("o_custkey").cast("string")
    text = [
        F.concat(F.lit("Orders rose to "), amount, F.lit(". Customer "), customer, F.lit(" was the largest contributor.")),
        F.concat(F.lit("Orders fell due to customer "), customer, F.lit(", which came to "), amount, F.lit(".")),
        F.concat(F.lit("Several priorities Each contributed "), amount, F.lit(".")),
        F.concat(F.lit("Orders changed by "), F.format_number(F.col("o_totalprice") + 1.5, 2), F.lit(" for customer "), customer),
        F.concat(F.lit("Customer "), customer, F.lit(" and others together account for -"), amount, F.lit(" points")),
        F.lit("No figure is given, and no cause"),
    ]
    narrative = F.lit(None).cast("string")
    for i, t in enumerate(text):
        narrative = F.when(key % 6 == i, t).otherwise(narrative)
    return table(spark, folder, "orders").select(
        key.alias("answer_id"), F.col("o_orderpriority").alias("case_id"), status.alias("model"),
        (key % 3 + 1).cast("int").alias("attempt"),
        F.when(key % 4 == 0, F.lit("code")).otherwise(F.lit("change")).alias("route"), (key % 4 != 0).alias("verified"),
        narrative.alias("narrative"),
        F.when(key % 11 != 0, F.concat(F.lit("total "), amount, F.lit(" customer "), customer)).alias("source_text"),
        F.round(F.col("o_totalprice") / 10000, 2).alias("seconds"), (F.col("o_custkey") % 300).alias("output_tokens"),
        F.when(key % 97 == 0, F.lit("timeout")).alias("error"),
        "o_totalprice", "o_custkey", "o_orderdate",
    )


ANSWERS = """answers AS (SELECT o_orderkey AS answer_id, o_orderpriority AS case_id, o_orderstatus AS model, CAST(o_orderkey % 3 + 1 AS INTEGER) AS attempt,
  CASE WHEN o_orderkey % 4 = 0 THEN 'code' ELSE 'change' END AS route, o_orderkey % 4 <> 0 AS verified,
  CASE o_orderkey % 6
    WHEN 0 THEN 'Orders rose to ' || format('{:,.2f}', o_totalprice) || '. Customer ' || o_custkey || ' was the largest contributor.'
    WHEN 1 THEN 'Orders fell due to customer ' || o_custkey || ', which came to ' || format('{:,.2f}', o_totalprice) || '.'
    WHEN 2 THEN 'Several priorities Each contributed ' || format('{:,.2f}', o_totalprice) || '.'
    WHEN 3 THEN 'Orders changed by ' || format('{:,.2f}', o_totalprice + 1.5) || ' for customer ' || o_custkey
    WHEN 4 THEN 'Customer ' || o_custkey || ' and others together account for -' || format('{:,.2f}', o_totalprice) || ' points'
    ELSE 'No figure is given, and no cause' END AS narrative,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'total ' || format('{:,.2f}', o_totalprice) || ' customer ' || o_custkey END AS source_text,
  round(o_totalprice / 10000, 2) AS seconds, o_custkey % 300 AS output_tokens, CASE WHEN o_orderkey % 97 = 0 THEN 'timeout' END AS error,
  o_totalprice, o_custkey, o_orderdate FROM orders)"""


def numbers_sql(text: str) -> str:
    return (
        f"list_distinct(list_transform(regexp_extract_all({text}, '{fixed.NUMBER_PATTERN}'),"
        " lambda t: abs(TRY_CAST(rtrim(replace(t, ',', ''), '.') AS DOUBLE))))"
    )


INVENTED = f"list_filter({numbers_sql('narrative')}, lambda n: len(list_filter({numbers_sql('source_text')}, lambda c: abs(n - c) < 0.051)) = 0)"
SUMMED = "(?i)(" + "|".join(fixed.SUMMED_PATTERNS) + ")"


@query(f"WITH {ANSWERS}, n AS (SELECT answer_id, {numbers_sql('narrative')} AS numbers FROM answers) SELECT answer_id, CAST(len(numbers) AS INTEGER) AS n, round(coalesce(list_sum(numbers), 0), 2) AS total FROM n")
def audit_numbers(spark, folder):
    numbers = answers(spark, folder).select("answer_id", g.extract_numbers(F.col("narrative")).alias("numbers"))
    total = F.aggregate("numbers", F.lit(0.0), lambda a, n: a + n)
    return rounded(numbers.select("answer_id", F.size("numbers").alias("n"), total.alias("total")), 2, ["total"])


@query(f"WITH {ANSWERS}, i AS (SELECT answer_id, CASE WHEN source_text IS NOT NULL THEN {INVENTED} END AS invented FROM answers)"
       " SELECT answer_id, coalesce(len(invented) = 0, false) AS passed, CASE WHEN len(invented) > 0 THEN round(list_min(invented), 2) END AS first_invented FROM i")
def audit_invented(spark, folder):
    found = answers(spark, folder).select("answer_id", g.invented_numbers(F.col("narrative"), F.col("source_text")).alias("invented"))
    return found.select(
        "answer_id", F.when(F.col("invented").isNull(), False).otherwise(F.size("invented") == 0).alias("passed"),
        F.round(F.array_min("invented"), 2).alias("first_invented"),
    )


@query(f"WITH {ANSWERS} SELECT answer_id, nullif(regexp_extract(narrative, '{fixed.CAUSAL_PATTERN}', 0), '') AS claim FROM answers")
def audit_causal(spark, folder):
    return answers(spark, folder).select("answer_id", g.causal_claim(F.col("narrative")).alias("claim"))


@query(f"WITH {ANSWERS} SELECT answer_id, nullif(regexp_extract(narrative, '{SUMMED}', 0), '') AS phrase FROM answers")
def audit_summed(spark, folder):
    return answers(spark, folder).select("answer_id", g.summed_contributions(F.col("narrative")).alias("phrase"))


@query(f"""WITH {ANSWERS} SELECT answer_id, contains(lower(narrative), 'customer') AND contains(lower(narrative), CAST(o_custkey AS VARCHAR)) AS mentioned,
  contains(lower(split_part(narrative, '.', 1)), 'customer') AND contains(lower(split_part(narrative, '.', 1)), CAST(o_custkey AS VARCHAR)) AS leading,
  len(list_filter({numbers_sql('narrative')}, lambda n: abs(n - o_totalprice) <= 0.01)) > 0 AS reported FROM answers""")
def audit_mentions(spark, folder):
    text, terms = F.col("narrative"), F.array(F.lit("Customer"), F.col("o_custkey").cast("string"))
    return answers(spark, folder).select(
        "answer_id", g.mentions(text, terms).alias("mentioned"), g.mentions(g.first_sentence(text), terms).alias("leading"),
        g.reports_value(text, F.col("o_totalprice"), F.lit(0.01)).alias("reported"),
    )


@query("SELECT text_id, n, n_numbers FROM (SELECT conv_id * 1000 + turn AS text_id, length(text) AS n, CAST(len(list_distinct(regexp_extract_all(text, '\\d+'))) AS INTEGER) AS n_numbers FROM conversations)")
def audit_conversations(spark, folder):
    """Figures in whole conversation texts."""
    text = F.col("text")
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), F.length(text).cast("bigint").alias("n"),
        F.size(g.extract_numbers(text)).alias("n_numbers"),
    )


# ---------------------------------------------------------------- grading


def _expected(spark, folder) -> DataFrame:
    """The same assertions for every case; the cases are the priorities found in the table."""
    rows = [
        g.expectation("", "routing", "route", ["change"]), g.expectation("", "routing", "verified", value=1.0),
        g.expectation("", "interpretation", "metric", ["o_totalprice"]), g.expectation("", "interpretation", "period", ["1999"]),
        g.expectation("", "interpretation", "dimensions", ["status", "priority"]),
        g.expectation("", "correctness", "total_change", value=5.0, tolerance=2.5),
        g.expectation("", "correctness", "top_slice", ["A", "F"]), g.expectation("", "correctness", "contribution", ["F", "A"], 50.0, 10.0),
        g.expectation("", "correctness", "decoy", ["O", "N"]), g.expectation("", "correctness", "checks_pass"),
        g.expectation("", "correctness", "executed", value=1.0), g.expectation("", "correctness", "repairs_at_most", value=2.0),
        g.expectation("", "correctness", "reports_value", value=17.0), g.expectation("", "communication", "mentions", ["Customer", "1"]),
        g.expectation("", "communication", "leads_with", ["customer"]), g.expectation("", "communication", "no_invented_numbers"),
        g.expectation("", "communication", "no_causal_claim"), g.expectation("", "communication", "no_summed_contributions"),
    ]
    cases = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("case_id")).distinct()
    wanted = F.array(*[
        F.struct(
            F.lit(family).alias("family"), F.lit(assertion).alias("assertion"),
            (F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")).alias("terms"),
            F.lit(value).cast("double").alias("value"), F.lit(tolerance).cast("double").alias("tolerance"),
        )
        for _, family, assertion, terms, value, tolerance in rows
    ])
    return cases.select("case_id", F.inline(wanted))


def graded(spark, folder) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = answers(spark, folder)
    segment = F.concat_ws(" x ", "l_returnflag", "l_linestatus")
    analysed = orders.filter(F.col("answer_id") % 4 != 0).select(
        "answer_id", F.lit("o_totalprice").alias("metric"), F.year("o_orderdate").cast("string").alias("period_after"),
        F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("priority"), F.lit("status"))).otherwise(F.array(F.lit("status"))).alias("dimensions"),
        (F.col("o_totalprice") / 50000).alias("pct_change"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("F x A")).otherwise(F.lit("A x O")).alias("headline"),
    )
    totals = lines.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.sum("l_quantity").alias("total"))
    slices = (
        lines.groupBy(F.col("l_orderkey").alias("answer_id"), segment.alias("segment")).agg(F.sum("l_quantity").alias("quantity"))
        .join(totals, "answer_id")
        .select(
            "answer_id", "segment", (100 * F.col("quantity") / F.col("total")).alias("contribution_pp"),
            F.col("quantity").alias("own_pct_change"), (F.col("quantity") >= 25).alias("is_decoy"),
        )
    )
    checks = lines.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").cast("string").alias("check"), (F.col("l_quantity") > 5).alias("passed"))
    return audit_answers(orders, _expected(spark, folder), analysed, slices, checks, _attempts(spark, folder))


def _attempts(spark, folder) -> DataFrame:
    """Events as attempts: a user's events are the attempts at one answer."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("answer_id"), F.col("event_id").alias("step"),
        F.concat(F.lit(" "), "event_type", F.lit(" "), F.floor("value").cast("string")).alias("code"),
        (F.col("event_type") != "error").alias("ok"), F.when(F.col("value") > 5, F.col("props")).otherwise(F.lit(" ")).alias("output"),
    )


ATTEMPTS = """attempts AS (SELECT user_id AS answer_id, event_id AS step, event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS code,
  event_type <> 'error' AS ok, CASE WHEN value > 5 THEN props ELSE ' ' END AS output FROM events)"""


def _signed(value: str, digits: int) -> str:
    return f"printf('%+.{digits}f', round({value}, {digits}))"


def _graded_sql() -> str:
    change, code = "has_change", "successful IS NOT NULL"
    numbers = f"array_to_string(list_transform(list_sort({numbers_sql('narrative')}), lambda n: n::VARCHAR), ', ')"
    lead = "split_part(narrative, '.', 1)"
    invented = f"coalesce('invented [' || array_to_string(list_transform(list_sort(CASE WHEN source_text IS NOT NULL THEN {INVENTED} END), lambda n: n::VARCHAR), ', ') || ']', 'no source to trace figures to')"
    lacking = "array_to_string(list_filter(['Customer', '1'], lambda t: NOT contains(lower(narrative), lower(t))), ', ')"
    # family, assertion, when there is something to compare, whether it holds, what is said about it
    tests = [
        ("routing", "route change", "true", "route = 'change'", "'routed to ' || route"),
        ("routing", "verified 1.0", "true", "verified", "'verified=' || verified"),
        ("interpretation", "metric o_totalprice", change, "true", "'chose o_totalprice'"),
        ("interpretation", "period 1999", change, "year(o_orderdate) = 1999", "'compared into ' || year(o_orderdate)"),
        ("interpretation", "dimensions status, priority", change, "o_custkey % 2 = 0", "CASE WHEN o_custkey % 2 = 0 THEN 'missing []' ELSE 'missing [priority]' END"),
        ("correctness", "total_change 5.0", change, "abs(o_totalprice / 50000 - 5.0) <= 2.5", f"{_signed('o_totalprice / 50000', 2)} || '% against +5.00%'"),
        ("correctness", "top_slice A, F", change, "o_custkey % 3 = 0", "'top contributor was ' || CASE WHEN o_custkey % 3 = 0 THEN 'F x A' ELSE 'A x O' END"),
        ("correctness", "contribution F, A 50.0", change, "abs(100 * af / total - 50.0) <= 10.0", f"coalesce({_signed('100 * af / total', 2)} || ' pp against +50.00 pp', 'no such slice')"),
        ("correctness", "decoy O, N", change, "n_o >= 25", f"coalesce('own ' || {_signed('n_o', 1)} || '%, contributes ' || {_signed('100 * n_o / total', 2)} || ' pp', 'no such slice')"),
        ("correctness", "checks_pass", change, "n_checks = n_passed", "coalesce(n_passed || ' of ' || n_checks || ' passed', 'no checks')"),
        ("correctness", "executed 1.0", code, "successful >= 1", "successful || ' successful attempt(s)'"),
        ("correctness", "repairs_at_most 2.0", code, "failed <= 2", "failed || ' failed attempt(s)'"),
        ("correctness", "reports_value 17.0", "true", f"len(list_filter({numbers_sql('narrative')}, lambda n: abs(n - 17.0) <= 0.01)) > 0", f"'found [' || {numbers} || ']'"),
        ("communication", "mentions Customer, 1", "true", "contains(lower(narrative), 'customer') AND contains(narrative, '1')", f"'missing [' || {lacking} || ']'"),
        ("communication", "leads_with customer", "true", f"contains(lower({lead}), 'customer')", f"'first sentence: ' || left({lead}, {g.LEAD_SHOWN})"),
        ("communication", "no_invented_numbers", "true", f"source_text IS NOT NULL AND len({INVENTED}) = 0", invented),
        ("communication", "no_causal_claim", "true", f"NOT regexp_matches(narrative, '{fixed.CAUSAL_PATTERN}')", f"coalesce(nullif(regexp_extract(narrative, '{fixed.CAUSAL_PATTERN}', 0), ''), 'none')"),
        ("communication", "no_summed_contributions", "true", f"NOT regexp_matches(narrative, '{SUMMED}')", f"coalesce(nullif(regexp_extract(narrative, '{SUMMED}', 0), ''), 'none')"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT answer_id, case_id, model, attempt, '{family}' AS family, '{name}' AS assertion, ({possible}) AND coalesce({test}, false) AS passed,"
        f" CASE WHEN {possible} THEN {detail} ELSE format('routed to ''{{}}'', so there is nothing to compare', route) END AS detail FROM joined"
        for family, name, possible, test, detail in tests
    )
    return f"""{ANSWERS}, {ATTEMPTS}, line AS (SELECT l_orderkey AS answer_id, sum(l_quantity) AS total,
    sum(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS af, sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS n_o,
    count(*) AS n_checks, count(*) FILTER (l_quantity > 5) AS n_passed FROM lineitem GROUP BY 1),
  tried AS (SELECT answer_id, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed FROM attempts GROUP BY 1),
  joined AS (SELECT a.*, a.answer_id % 4 <> 0 AS has_change, line.* EXCLUDE (answer_id), tried.* EXCLUDE (answer_id) FROM answers a
    LEFT JOIN line ON line.answer_id = a.answer_id LEFT JOIN tried ON tried.answer_id = a.answer_id WHERE error IS NULL),
  results AS ({rows})"""


GRADED = _graded_sql()


@query(f"WITH {GRADED} SELECT answer_id, family, assertion, passed, detail FROM results")
def audit_results(spark, folder):
    return graded(spark, folder).select("answer_id", "family", "assertion", "passed", "detail")


@query(f"""WITH {ATTEMPTS}, islands AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY answer_id ORDER BY step) AS island FROM attempts),
  runs AS (SELECT answer_id, max(n) AS longest FROM (SELECT answer_id, island, count(*) AS n FROM islands WHERE NOT ok GROUP BY ALL) GROUP BY 1)
SELECT a.answer_id, count(*) AS attempts, count(*) FILTER (ok) AS successful, count(*) FILTER (ok AND trim(output) <> '') AS informative,
  count(*) FILTER (NOT ok) AS failed, count(*) - count(DISTINCT code) AS resubmitted, coalesce(min(longest), 0) AS longest_failure_run
FROM attempts a LEFT JOIN runs ON runs.answer_id = a.answer_id GROUP BY a.answer_id""")
def audit_attempts(spark, folder):
    return attempt_summary(_attempts(spark, folder))


@query(f"""WITH {ATTEMPTS}, coarse AS (SELECT answer_id, ok, CASE WHEN step % 5 = 0 THEN NULL ELSE step // 2 END AS step FROM attempts),
  islands AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY answer_id ORDER BY step NULLS LAST, ok ROWS UNBOUNDED PRECEDING) AS island FROM coarse),
  runs AS (SELECT answer_id, max(n) AS longest FROM (SELECT answer_id, island, count(*) AS n FROM islands WHERE NOT ok GROUP BY ALL) GROUP BY 1)
SELECT a.answer_id, coalesce(min(longest), 0) AS longest_failure_run FROM coarse a LEFT JOIN runs ON runs.answer_id = a.answer_id GROUP BY a.answer_id""")
def audit_repeated_steps(spark, folder):
    """Several attempts at one step, and attempts without a step."""
    step = F.col("step")
    coarse = _attempts(spark, folder).withColumn("step", F.when(step % 5 != 0, F.floor(step / 2)))
    return g.longest_failure_runs(coarse)


# ---------------------------------------------------------------- reports


def _results(spark, folder) -> DataFrame:
    """Line items as graded assertions of the run their order belongs to."""
    families = F.array(*[F.lit(f) for f in r.FAMILIES])
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("case_id"), F.col("o_orderstatus").alias("model"), F.year("o_orderdate").alias("attempt")
    )
    return table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "case_id", "model", "attempt", F.element_at(families, F.col("l_linenumber") % 4 + 1).alias("family"),
        F.concat(F.lit("line "), F.col("l_linenumber")).alias("assertion"), (F.col("l_quantity") > 10).alias("passed"),
        F.col("l_returnflag").alias("detail"),
    )


def _runs(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("case_id"), F.col("o_orderstatus").alias("model"), F.year("o_orderdate").alias("attempt")
    ).agg(
        (F.max("o_totalprice") / 1000).alias("seconds"), F.count("*").alias("output_tokens"),
        F.round(F.sum("o_totalprice") / 1e6, 6).alias("cost_usd"),
        F.when(F.max("o_orderkey") % 7 == 0, F.lit("timeout")).alias("error"),
    )


RESULTS = """results AS (SELECT o_orderpriority AS case_id, o_orderstatus AS model, CAST(year(o_orderdate) AS INTEGER) AS attempt,
  ['routing', 'interpretation', 'correctness', 'communication'][l_linenumber % 4 + 1] AS family, 'line ' || l_linenumber AS assertion,
  l_quantity > 10 AS passed, l_returnflag AS detail FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
runs AS (SELECT o_orderpriority AS case_id, o_orderstatus AS model, CAST(year(o_orderdate) AS INTEGER) AS attempt, max(o_totalprice) / 1000 AS seconds,
  count(*) AS output_tokens, round(sum(o_totalprice) / 1e6, 6) AS cost_usd, CASE WHEN max(o_orderkey) % 7 = 0 THEN 'timeout' END AS error FROM orders GROUP BY ALL),
completed AS (SELECT * FROM results r WHERE NOT EXISTS (SELECT 1 FROM runs e
  WHERE e.error IS NOT NULL AND e.case_id = r.case_id AND e.model = r.model AND e.attempt = r.attempt)),
per_run AS (SELECT case_id, model, attempt, count(*) FILTER (passed) AS passed, count(*) AS total FROM completed GROUP BY ALL)"""


@query(f"""WITH {RESULTS} SELECT model, count(*) FILTER (passed) AS passed, count(*) AS total, round(100.0 * count(*) FILTER (passed) / count(*), 6) AS pct,
  (SELECT round(median(seconds), 6) FROM runs WHERE runs.model = completed.model AND error IS NULL) AS median_seconds FROM completed GROUP BY model""")
def eval_scores(spark, folder):
    return rounded(r.score_by_model(_results(spark, folder), _runs(spark, folder)), 6, ["pct", "median_seconds"])


@query(f"WITH {RESULTS} SELECT model, " + ", ".join(f"round(100.0 * count(*) FILTER (passed AND family = '{f}') / count(*) FILTER (family = '{f}'), 6) AS {f}" for f in r.FAMILIES) + " FROM completed GROUP BY model")
def eval_families(spark, folder):
    return rounded(r.score_by_family(_results(spark, folder), _runs(spark, folder)), 6, r.FAMILIES)


@query(f"WITH {RESULTS} SELECT case_id, model, min(passed) AS worst, max(passed) AS best, max(total) AS total, count(*) AS runs FROM per_run GROUP BY ALL")
def eval_cases(spark, folder):
    return r.score_by_case(_results(spark, folder), _runs(spark, folder))


@query(f"""WITH {RESULTS}, passes AS (SELECT model, attempt, 100.0 * sum(passed) / sum(total) AS pct FROM per_run GROUP BY ALL)
SELECT model, round(avg(pct), 6) AS mean_pct, round(coalesce(stddev_samp(pct), 0), 6) AS sd, round(min(pct), 6) AS worst_pct, round(max(pct), 6) AS best_pct, count(*) AS passes FROM passes GROUP BY model""")
def eval_variance(spark, folder):
    return rounded(r.run_variance(_results(spark, folder), _runs(spark, folder)), 6, ["mean_pct", "sd", "worst_pct", "best_pct"])


@query(f"WITH {RESULTS} SELECT model, case_id, min(passed) AS worst, max(passed) AS best FROM per_run GROUP BY ALL HAVING min(passed) < max(passed)")
def eval_unstable(spark, folder):
    return r.unstable_cases(_results(spark, folder), _runs(spark, folder))


@query(f"WITH {RESULTS} SELECT family, assertion, count(*) AS failures FROM results WHERE NOT passed GROUP BY ALL ORDER BY failures DESC, family, assertion LIMIT 8")
def eval_failures(spark, folder):
    return r.common_failures(_results(spark, folder))


@query(f"WITH {RESULTS} SELECT count(*) FILTER (passed) AS passed, count(*) AS total, round(count(*) FILTER (passed) / CAST(count(*) AS DOUBLE), 6) AS score, count(*) FILTER (passed) / CAST(count(*) AS DOUBLE) >= 0.8 AS ok FROM results")
def eval_gate(spark, folder):
    return rounded(r.gate(_results(spark, folder)), 6, ["score"])


@query(f"""WITH {RESULTS} SELECT model, count(*) AS calls, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(seconds), 2) AS seconds, round(sum(cost_usd), 3) AS cost_usd,
  round(sum(output_tokens) / sum(seconds), 6) AS tokens_per_second FROM runs GROUP BY model""")
def eval_usage(spark, folder):
    found = eval_report(_results(spark, folder), _runs(spark, folder))["usage"].drop("runs", "input_tokens")
    return rounded(rounded(rounded(found, 2, ["seconds"]), 3, ["cost_usd"]), 6, ["tokens_per_second"])


# one run per order, its line items as calls; every seventh order made none
CALLS = """called AS (SELECT o_orderstatus AS model, o_orderkey, l_orderkey, l_partkey AS input_tokens, CAST(l_quantity AS BIGINT) AS output_tokens,
  l_extendedprice / 1000 AS seconds, l_tax AS cost_usd FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 7 <> 0)"""


def _runs_with_calls(spark, folder) -> DataFrame:
    runs = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("case_id"), F.col("o_orderstatus").alias("model"), F.col("o_orderkey").alias("attempt")
    )
    calls = table(spark, folder, "lineitem").where("l_orderkey % 7 <> 0").join(runs, F.col("l_orderkey") == F.col("attempt")).select(
        "case_id", "model", "attempt", F.col("l_partkey").alias("input_tokens"), F.col("l_quantity").cast("bigint").alias("output_tokens"),
        (F.col("l_extendedprice") / 1000).alias("seconds"), F.col("l_tax").alias("cost_usd"),
    )
    return r.with_calls(runs, calls)


@query(f"""WITH {CALLS} SELECT model, count(DISTINCT o_orderkey) AS runs, count(l_orderkey) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(seconds), 2) AS seconds, round(sum(cost_usd), 3) AS cost_usd,
  round(sum(output_tokens) / sum(seconds), 6) AS tokens_per_second FROM called GROUP BY model""")
def eval_usage_calls(spark, folder):
    """Several calls a run, or none."""
    return rounded(rounded(rounded(r.usage(_runs_with_calls(spark, folder)), 2, ["seconds"]), 3, ["cost_usd"]), 6, ["tokens_per_second"])


@query(f"""WITH {CALLS} SELECT model, format('{{:,}}', count(l_orderkey)) || ' call(s) in ' || format('{{:,}}', count(DISTINCT o_orderkey)) || ' run(s), '
  || format('{{:,}}', sum(output_tokens)::BIGINT) || ' tokens out, ' || format('{{:.1f}} s, $', sum(seconds)) || format('{{:.4f}}', sum(cost_usd)) AS usage FROM called GROUP BY model""")
def eval_usage_text(spark, folder):
    return r.usage_text(_runs_with_calls(spark, folder))


@query("""SELECT o_orderpriority AS "case", o_orderstatus AS model, o_orderkey AS attempt, 'change' AS route, count(*) FILTER (l_quantity > 10) AS passed, count(l_orderkey) AS total,
  count(*) FILTER (NOT l_quantity > 10) AS n_failures, min(round(o_totalprice / 1000, 2)) AS seconds, min(o_custkey) AS output_tokens
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def eval_run_records(spark, folder):
    """One run per order, its line items as assertions; written as JSON lines and read back."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("case_id"), F.col("o_orderstatus").alias("model"), F.col("o_orderkey").alias("attempt"),
        F.lit("change").alias("route"), F.round(F.col("o_totalprice") / 1000, 2).alias("seconds"),
        F.col("o_custkey").alias("output_tokens"), F.lit(None).cast("string").alias("error"), F.lit("text").alias("narrative"),
    )
    results = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("attempt")).select(
        "case_id", "model", "attempt", F.lit("correctness").alias("family"), F.col("l_linenumber").cast("string").alias("assertion"),
        (F.col("l_quantity") > 10).alias("passed"), F.col("l_returnflag").alias("detail"),
    )
    path = f"{shared_folder(spark)}/deltascope-runs-{uuid.uuid4().hex}.jsonl"
    write_run_records(orders, results, path)
    records = spark.read.schema(run_records(orders, results).schema).json(path)
    return records.select(
        "case", "model", "attempt", "route", "passed", "total", F.size("failures").cast("bigint").alias("n_failures"), "seconds", "output_tokens"
    )
