"""Auditing written answers in bulk: does every figure trace back to something computed, is
nothing claimed that the data cannot show, and is the computed result the expected one.

Tables
    answers   answer_id, case_id, model, attempt, route, verified, narrative, source_text,
              seconds, output_tokens, error
    expected  case_id, family, assertion, terms array<string>, value, tolerance
    analyses  answer_id, metric, period_after, dimensions array<string>, pct_change, headline
    slices    answer_id, segment, contribution_pp, own_pct_change, is_decoy  (crossed slices)
    checks    answer_id, check, passed
    attempts  answer_id, step, code, ok, output
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from deltascope.functions import fixed
from deltascope.sources.materialize import materialize

# ---------------------------------------------------------------- single texts


def extract_numbers(text: Column) -> Column:
    """Distinct magnitudes of the numbers in a text."""
    tokens = F.regexp_extract_all(text, F.lit(fixed.NUMBER_PATTERN), F.lit(0))
    magnitudes = F.transform(tokens, lambda t: F.abs(F.regexp_replace(t, ",", "").try_cast("double")))
    return F.array_distinct(F.filter(magnitudes, lambda n: n.isNotNull()))


def invented_numbers(narrative: Column, source: Column, tolerance: float = fixed.FIGURE_TOLERANCE) -> Column:
    """Numbers in the narrative that are near none in the source; null without a source."""
    return untraced_numbers(extract_numbers(narrative), F.when(source.isNotNull(), extract_numbers(source)), tolerance)


def untraced_numbers(numbers: Column, computed: Column, tolerance: float = fixed.FIGURE_TOLERANCE) -> Column:
    """Numbers that are near none of the computed ones; null without those.

    Most figures are quoted exactly and are set aside by hashing; only the rest is compared
    one by one.
    """
    inexact = F.array_except(numbers, computed)
    return F.array_sort(F.filter(inexact, lambda n: ~F.exists(computed, lambda c: F.abs(n - c) < F.lit(tolerance))))


def _first_match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found)


def causal_claim(narrative: Column) -> Column:
    """The first phrase that claims a cause for the metric's move, or null."""
    return _first_match(narrative, fixed.CAUSAL_PATTERN)


def summed_contributions(narrative: Column) -> Column:
    """The first phrase that adds up overlapping segments, or null."""
    return _first_match(narrative, "(?i)(" + "|".join(fixed.SUMMED_PATTERNS) + ")")


def missing_terms(text: Column, terms: Column) -> Column:
    """The terms that do not occur in a text, case aside."""
    return F.filter(terms, lambda t: ~F.contains(F.lower(text), F.lower(t)))


def mentions(text: Column, terms: Column) -> Column:
    return F.size(missing_terms(text, terms)) == 0


def first_sentence(text: Column) -> Column:
    return F.substring_index(text, ".", 1)


def reports_value(narrative: Column, value: Column, tolerance: Column) -> Column:
    return F.exists(extract_numbers(narrative), lambda n: F.abs(n - F.abs(value)) <= tolerance)


def segment_set(segment: Column) -> Column:
    """The parts of a crossed segment, without order."""
    return F.array_sort(F.array_distinct(F.transform(F.split(segment, " x "), lambda p: F.trim(p))))


# ---------------------------------------------------------------- attempts


# How many consecutive steps are looked at together when runs of failures are measured.
CHUNK = 1_000


def _join_runs(left: Column, right: Column) -> Column:
    """Two adjacent stretches of attempts as one: its length, the failures at its head and
    tail, and the longest run of failures in it."""
    return F.struct(
        (left["n"] + right["n"]).alias("n"),
        F.when(left["head"] == left["n"], left["n"] + right["head"]).otherwise(left["head"]).alias("head"),
        F.when(right["tail"] == right["n"], right["n"] + left["tail"]).otherwise(right["tail"]).alias("tail"),
        F.greatest(left["best"], right["best"], left["tail"] + right["head"]).alias("best"),
    )


def longest_failure_runs(attempts: DataFrame) -> DataFrame:
    """`(answer_id, longest_failure_run)`.

    Attempts go by their step. Of those that share a step the failures come first, and
    attempts without a step follow all others, as one step; so a step is a stretch that two
    counts describe. Stretches of `CHUNK` steps are summed up on their own, then stretches of
    stretches: no task ever sees all attempts at one answer, however many there are.
    """
    bounds = (attempts.agg(F.max(F.abs(F.col("step").cast("bigint")))).first()[0] or 0) + 1
    failures = F.col("n") - F.col("worked")
    stretches = (
        attempts.groupBy("answer_id", F.coalesce(F.col("step").cast("bigint"), F.lit(bounds)).alias("step"))
        .agg(F.count("*").alias("n"), F.count_if("ok").alias("worked"))
        .select("answer_id", "step", F.struct(
            "n", failures.alias("head"), F.when(F.col("worked") == 0, F.col("n")).otherwise(0).alias("tail"), failures.alias("best")
        ).alias("stretch"))
    )
    nothing = F.struct(*[F.lit(0).cast("bigint").alias(name) for name in ("n", "head", "tail", "best")])
    while True:
        parts = F.array_sort(F.collect_list(F.struct("step", "stretch")))
        whole = F.aggregate(parts, nothing, lambda seen, part: _join_runs(seen, part["stretch"]))
        chunk = F.floor(F.col("step") / CHUNK)
        stretches = stretches.groupBy("answer_id", chunk.alias("chunk")).agg(whole.alias("stretch")).withColumnRenamed("chunk", "step")
        bounds = bounds // CHUNK
        if bounds == 0:
            break
    # what is left are the stretches on either side of step zero, in practice one per answer
    return stretches.groupBy("answer_id").agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("step", "stretch"))), nothing, lambda seen, part: _join_runs(seen, part["stretch"])
        )["best"].alias("longest_failure_run")
    )


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Per answer: attempts that worked, that showed something, that failed, that repeated
    earlier code, and the longest run of failures."""
    shown = F.coalesce(F.trim("output"), F.lit("")) != ""
    repeats = (
        attempts.groupBy("answer_id", F.trim("code").alias("code")).agg(F.count("*").alias("n"))
        .groupBy("answer_id").agg(F.sum(F.col("n") - 1).alias("resubmitted"))
    )
    return _attempt_counts(attempts, shown).join(repeats, "answer_id").join(longest_failure_runs(attempts), "answer_id")


def _attempt_counts(attempts: DataFrame, shown: Column) -> DataFrame:
    return attempts.groupBy("answer_id").agg(
        F.count("*").alias("attempts"),
        F.count_if("ok").alias("successful"),
        F.count_if(F.col("ok") & shown).alias("informative"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


# ---------------------------------------------------------------- grading

DEFAULT_TOLERANCE = {"total_change": 0.2, "contribution": 0.1, "reports_value": 0.01}


def expectation(
    case_id: str, family: str, assertion: str, terms: list[str] = (), value: float | None = None,
    tolerance: float | None = None,
) -> tuple:
    """One row of the `expected` table."""
    return (case_id, family, assertion, list(terms), value, DEFAULT_TOLERANCE.get(assertion) if tolerance is None else tolerance)


EXPECTED_SCHEMA = (
    "case_id string, family string, assertion string, terms array<string>, value double, tolerance double"
)


def _empty(answers: DataFrame, schema: str) -> DataFrame:
    kind = answers.schema["answer_id"].dataType.simpleString()
    return answers.sparkSession.createDataFrame([], f"answer_id {kind}, {schema}")


def audit_answers(
    answers: DataFrame,
    expected: DataFrame,
    analyses: DataFrame | None = None,
    slices: DataFrame | None = None,
    checks: DataFrame | None = None,
    attempts: DataFrame | None = None,
) -> DataFrame:
    """Grade every answer that did not end in an error against every expectation of its case.

    Each text is searched once per answer, before the answer meets its expectations; every
    join is an equality on an answer or a case, and no text takes part in one.
    """
    analyses = analyses if analyses is not None else _empty(
        answers, "metric string, period_after string, dimensions array<string>, pct_change double, headline string"
    )
    slices = slices if slices is not None else _empty(
        answers, "segment string, contribution_pp double, own_pct_change double, is_decoy boolean"
    )
    checks = checks if checks is not None else _empty(answers, "`check` string, passed boolean")
    attempts = attempts if attempts is not None else _empty(answers, "step int, code string, ok boolean, output string")

    text, source = F.col("narrative"), F.col("source_text")
    told = ["answer_id", "case_id", "model", "attempt", "route", "verified"]
    completed = answers.filter(F.col("error").isNull())
    searched = completed.select(
        *told, extract_numbers(text).alias("numbers"),
        F.when(source.isNotNull(), extract_numbers(source)).alias("computed"),
        causal_claim(text).alias("causal"), summed_contributions(text).alias("summed"),
    )
    read = searched.select(
        *told, "numbers", untraced_numbers(F.col("numbers"), F.col("computed")).alias("invented"), "causal", "summed"
    )
    verdicts = checks.groupBy("answer_id").agg(
        F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed")
    )
    known = analyses.select(
        "answer_id", "metric", "period_after", "dimensions", "pct_change", "headline", F.lit(True).alias("has_change")
    )
    on_slices = F.col("assertion").isin(*SLICE_ASSERTIONS)
    # Expectations of the answer as a whole, those of the terms in its text, and those of one
    # of its slices, which need a join per expectation.
    on_terms = F.col("assertion").isin(*TERM_ASSERTIONS)
    whole = (
        read.join(known, "answer_id", "left")
        .join(verdicts, "answer_id", "left")
        .join(_attempt_counts(attempts, F.lit(True)).select("answer_id", "successful", "failed"), "answer_id", "left")
        .join(expected.filter(~on_slices & ~on_terms), "case_id")
    )
    named = expected.filter(on_terms)
    by_terms = found_terms(completed, named).join(named, "case_id")
    crossed = slices.select(
        "answer_id", F.array_join(segment_set(F.col("segment")), "\n").alias("parts"), "contribution_pp", "own_pct_change", "is_decoy",
    )
    parts = (
        read.select("answer_id", "case_id", "model", "attempt", "route")
        .join(known.select("answer_id", "has_change"), "answer_id", "left")
        .join(expected.filter(on_slices), "case_id")
        .withColumn("parts", F.array_join(F.array_sort(F.array_distinct("terms")), "\n"))
        .join(crossed, ["answer_id", "parts"], "left")
    )
    return _verdict(whole, _whole_rules()).unionByName(_verdict(by_terms, _term_rules())).unionByName(_verdict(parts, _slice_rules()))


# How many terms are searched for at once; more are taken in blocks of cases.
TERMS_AT_ONCE = 100_000
# As much of a first sentence as a verdict shows.
LEAD_SHOWN = 120


def found_terms(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Which of the terms its case expects a narrative holds, and which its first sentence:
    `(answer_id, case_id, model, attempt, found, leading, lead)`.

    All terms are looked for together, in one pass over the lower-cased text. A narrative
    that is missing lacks nothing.
    """
    terms = expected.select("case_id", F.explode("terms").alias("term")).where(F.col("term").isNotNull())
    terms = materialize(terms.select("case_id", F.lower("term").alias("term")).distinct(), "terms")
    told, blocks = ["answer_id", "case_id", "model", "attempt"], max(1, -(-terms.count() // TERMS_AT_ONCE))
    read = answers.select(
        *told, F.lower("narrative").alias("text"), F.substring(first_sentence(F.col("narrative")), 1, LEAD_SHOWN).alias("lead")
    )
    schema = T.StructType([
        *[read.schema[c] for c in told], *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("found", "leading")], read.schema["lead"]
    ])
    parts = []
    for block in range(blocks):
        here = F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == block
        wanted: dict = {}
        for row in terms.where(here).collect():
            wanted.setdefault(row["case_id"], set()).add(row["term"])
        parts.append(read.where(here).mapInArrow(_searcher(wanted), schema))
    return reduce(DataFrame.unionByName, parts)


def _searcher(wanted: dict):
    """A pass over batches that looks for the terms wanted of each case."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in set().union(*wanted.values()) - {""}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        searchable = len(automaton) > 0
        for batch in batches:
            found, leading = [], []
            for case, text in zip(batch.column("case_id").to_pylist(), batch.column("text").to_pylist()):
                own = wanted.get(case, set())
                if text is None:
                    held = first = own
                else:
                    held, first, stop = own & {""}, own & {""}, text.find(".") if "." in text else len(text)
                    for end, term in automaton.iter(text) if own and searchable else ():
                        if term in own:
                            held.add(term)
                            if end < stop:
                                first.add(term)
                found.append(sorted(held))
                leading.append(sorted(first))
            columns = [batch.column(n) for n in ("answer_id", "case_id", "model", "attempt")]
            lists = [pa.array(x, pa.list_(pa.string())) for x in (found, leading)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *lists, batch.column("lead")], names=["answer_id", "case_id", "model", "attempt", "found", "leading", "lead"]
            )

    return run


def _verdict(rows: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    passed, detail = F.lit(False), F.concat(F.lit("unknown assertion "), F.col("assertion"))
    for kind, (test, explain) in rules.items():
        passed = F.when(F.col("assertion") == kind, test).otherwise(passed)
        detail = F.when(F.col("assertion") == kind, explain).otherwise(detail)
    impossible = F.lit(False)
    if "has_change" in rows.columns:
        impossible = F.col("assertion").isin(*CHANGE_ASSERTIONS) & F.col("has_change").isNull()
    if "successful" in rows.columns:
        impossible = impossible | (F.col("assertion").isin(*CODE_ASSERTIONS) & F.col("successful").isNull())
    routed = F.lit(None).cast("string")
    if "route" in rows.columns:
        routed = F.concat(F.lit("routed to '"), F.col("route"), F.lit("', so there is nothing to compare"))
    listed = F.when(F.size("terms") > 0, F.array_join("terms", ", "))
    name = F.concat_ws(" ", "assertion", listed, F.col("value").cast("string"))
    return rows.select(
        "answer_id", "case_id", "model", "attempt", "family", name.alias("assertion"),
        # a test that cannot be decided has failed
        F.coalesce(F.when(impossible, F.lit(False)).otherwise(passed), F.lit(False)).alias("passed"),
        F.coalesce(F.when(impossible, routed).otherwise(detail), F.lit("nothing to compare")).alias("detail"),
    )


CHANGE_ASSERTIONS = (
    "metric", "period", "dimensions", "total_change", "top_slice", "contribution", "checks_pass", "decoy",
)
CODE_ASSERTIONS = ("executed", "repairs_at_most")
SLICE_ASSERTIONS = ("contribution", "decoy")
TERM_ASSERTIONS = ("mentions", "leads_with")


def _said(known: Column, text: Column, otherwise: str) -> Column:
    """A sentence about figures, or what is wrong where there are none."""
    return F.when(known.isNotNull(), text).otherwise(otherwise)


def _slice_rules() -> dict[str, tuple[Column, Column]]:
    c, says = F.col, F.format_string
    return {
        "contribution": (
            F.abs(c("contribution_pp") - c("value")) <= c("tolerance"),
            _said(c("contribution_pp"), says("%+.2f pp against %+.2f pp", c("contribution_pp"), c("value")), "no such slice"),
        ),
        "decoy": (
            c("is_decoy"),
            _said(c("contribution_pp"), says("own %+.1f%%, contributes %+.2f pp", c("own_pct_change"), c("contribution_pp")), "no such slice"),
        ),
    }


def _term_rules() -> dict[str, tuple[Column, Column]]:
    def lacking(held: str) -> Column:
        return F.filter("terms", lambda t: ~F.array_contains(held, F.lower(t)))

    missing = F.array_join(lacking("found"), ", ")
    return {
        "mentions": (F.size(lacking("found")) == 0, F.format_string("missing [%s]", missing)),
        "leads_with": (F.size(lacking("leading")) == 0, F.format_string("first sentence: %s", "lead")),
    }


def _whole_rules() -> dict[str, tuple[Column, Column]]:
    """Per assertion: when it holds, and what to say about it."""
    c, says = F.col, F.format_string
    first, value, tolerance = F.get("terms", F.lit(0)), c("value"), c("tolerance")
    headline = segment_set(c("headline"))
    wanted = F.array_sort(F.array_distinct("terms"))
    lacking = F.filter("terms", lambda t: ~F.array_contains(c("dimensions"), t))
    return {
        "route": (c("route") == first, says("routed to %s", c("route"))),
        "verified": (c("verified") == (value == 1), says("verified=%s", c("verified").cast("string"))),
        "metric": (c("metric") == first, says("chose %s", c("metric"))),
        "period": (c("period_after") == first, says("compared into %s", c("period_after"))),
        "dimensions": (F.size(lacking) == 0, says("missing [%s]", F.array_join(lacking, ", "))),
        "total_change": (F.abs(c("pct_change") - value) <= tolerance, _said(c("pct_change"), says("%+.2f%% against %+.2f%%", c("pct_change"), value), "no change in percent")),
        "top_slice": (headline == wanted, says("top contributor was %s", c("headline"))),
        "checks_pass": (c("n_checks") == c("n_passed"), _said(c("n_checks"), says("%d of %d passed", c("n_passed"), c("n_checks")), "no checks")),
        "executed": (c("successful") >= F.coalesce(value, F.lit(1.0)), says("%d successful attempt(s)", c("successful"))),
        "repairs_at_most": (c("failed") <= value, says("%d failed attempt(s)", c("failed"))),
        "reports_value": (
            F.exists("numbers", lambda n: F.abs(n - F.abs(value)) <= tolerance),
            says("found [%s]", F.array_join(F.transform(F.array_sort("numbers"), lambda n: n.cast("string")), ", ")),
        ),
        "no_invented_numbers": (
            F.size("invented") == 0,
            _said(
                c("invented"), says("invented [%s]", F.array_join(F.transform("invented", lambda n: n.cast("string")), ", ")),
                "no source to trace figures to",
            ),
        ),
        "no_causal_claim": (c("causal").isNull(), F.coalesce("causal", F.lit("none"))),
        "no_summed_contributions": (c("summed").isNull(), F.coalesce("summed", F.lit("none"))),
    }
