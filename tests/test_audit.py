"""Every grader must be able to fail as well as to pass."""

import pytest
from pyspark.sql import functions as F

from deltascope import attempt_summary, audit_answers, eval_report, run_records, write_run_records
from deltascope.operators import audit as g

ANSWERS = (
    "answer_id int, case_id string, model string, attempt int, route string, verified boolean, narrative string,"
    " source_text string, seconds double, output_tokens int, error string"
)


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def over(spark, function, *values):
    return [r[0] for r in texts(spark, *values).orderBy("i").select(function(F.col("t"))).collect()]


def test_numbers(spark):
    found = over(spark, g.extract_numbers, "rose 1,234.50 to -3. Then 3 and 2026-03", "none", "1,")
    assert sorted(found[0]) == [3.0, 1234.5, 2026.0] and found[1] == [] and found[2] == [1.0]


def test_invented_numbers(spark):
    df = spark.createDataFrame(
        [("Rainfall and yield: r = -0.27.", "0.0514"), ("Rainfall and yield: r = 0.0514.", "0.0514"), ("Up 42.7 in all", "42.73"),
         ("Up 42.9 in all", "42.73"), ("Some 8 boats", None), ("nothing counted", "")],
        "narrative string, source string",
    )
    found = [r[0] for r in df.select(g.invented_numbers(F.col("narrative"), F.col("source"))).collect()]
    assert found == [[0.27], [], [], [42.9], None, []]


def test_causal_claims(spark):
    found = over(
        spark, g.causal_claim,
        "Catches fell due to storms off the northern banks.",
        "Lamps matter little here because they are a fortieth of the total.",
        "Yields dropped. Driven by nobody.", "Exports ROSE again, Driven By the harbours",
    )
    assert found == ["fell due to", None, None, "ROSE again, Driven By"]


def test_summed_contributions(spark):
    found = over(
        spark, g.summed_contributions, "Cod, herring and squid each contributed some six points.",
        "Cod x North came first with 7.4 pp.", "Together they account for most", "These sum to 31", "summing to",
    )
    assert found == ["each contribut", None, "Together they account", "sum to", None]


def test_terms(spark):
    df = spark.createDataFrame([("Three fleets grew. Cod x North was ahead.",), ("Cod x North was ahead. Two followed.",)], "t string")
    terms = F.array(F.lit("cod"), F.lit("NORTH"))
    assert [tuple(r) for r in df.select(g.mentions(F.col("t"), terms), g.mentions(g.first_sentence(F.col("t")), terms)).collect()] == [(True, False), (True, True)]


def test_attempts(spark):
    attempts = spark.createDataFrame(
        [(1, 1, "a", False, ""), (1, 2, "a ", False, ""), (1, 3, "b", True, " "), (1, 4, "c", False, ""), (1, 5, "d", True, "7"), (2, 1, "x", True, "1")],
        "answer_id int, step int, code string, ok boolean, output string",
    )
    found = {r["answer_id"]: r.asDict() for r in attempt_summary(attempts).collect()}
    assert found[1] == {"answer_id": 1, "attempts": 5, "successful": 2, "informative": 1, "failed": 3, "resubmitted": 1, "longest_failure_run": 2}
    assert found[2]["longest_failure_run"] == 0


def grade(spark, narrative="", route="change", source="total 16.11", expectations=(), analysis=None, slices=(), checks=(), attempts=(), error=None, verified=True):
    answers = spark.createDataFrame([(1, "c", "m", 1, route, verified, narrative, source, 1.0, 5, error)], ANSWERS)
    expected = spark.createDataFrame([g.expectation("c", "f", *e) for e in expectations], g.EXPECTED_SCHEMA)
    results = audit_answers(
        answers, expected,
        spark.createDataFrame([(1, *analysis)] if analysis else [], "answer_id int, metric string, period_after string, dimensions array<string>, pct_change double, headline string"),
        spark.createDataFrame([(1, *s) for s in slices], "answer_id int, segment string, contribution_pp double, own_pct_change double, is_decoy boolean"),
        spark.createDataFrame([(1, *c) for c in checks], "answer_id int, `check` string, passed boolean"),
        spark.createDataFrame([(1, *a) for a in attempts], "answer_id int, step int, code string, ok boolean, output string"),
    )
    return {r["assertion"]: (r["passed"], r["detail"]) for r in results.collect()}


def test_change_answers(spark):
    found = grade(
        spark, "Cod x North gave 7.4 points of the 12.3% rise.", source="12.34 7.41",
        analysis=("tonnes", "2025-09", ["fish"], 12.34, "North x Cod"),
        slices=[("Cod x North", 7.41, 22.0, False), ("Eel x South", 0.31, 140.0, True)],
        checks=[("a", True), ("b", False)],
        expectations=[
            ("metric", ["tonnes"]), ("metric", ["boats"]), ("period", ["2025-09"]), ("period", ["2025-08"]),
            ("dimensions", ["fish"]), ("dimensions", ["fish", "coast"]), ("total_change", [], 12.5), ("total_change", [], 20.0),
            ("top_slice", ["Cod", "North"]), ("top_slice", ["Squid", "East"]), ("contribution", ["North", "Cod"], 7.4),
            ("contribution", ["Cod", "North"], 2.0), ("contribution", ["Not", "There"], 1.0), ("decoy", ["South", "Eel"]),
            ("decoy", ["Cod", "North"]), ("checks_pass",), ("route", ["change"]), ("route", ["code"]), ("verified", [], 1.0), ("verified", [], 0.0),
            ("no_invented_numbers",), ("no_causal_claim",), ("mentions", ["cod"]), ("leads_with", ["east"]), ("executed",), ("unheard_of",),
        ],
    )
    passed = {name for name, (ok, _) in found.items() if ok}
    assert passed == {
        "metric tonnes", "period 2025-09", "dimensions fish", "total_change 12.5", "top_slice Cod, North",
        "contribution North, Cod 7.4", "decoy South, Eel", "route change", "verified 1.0",
        "no_invented_numbers", "no_causal_claim", "mentions cod",
    }
    assert len(found) == 26 and "coast" in found["dimensions fish, coast"][1] and "1 of 2" in found["checks_pass"][1]


def test_code_answers(spark):
    expectations = [("executed",), ("repairs_at_most", [], 1.0), ("reports_value", [], 3.1875), ("reports_value", [], 99.0), ("checks_pass",), ("metric", ["x"]), ("no_invented_numbers",)]
    found = grade(
        spark, "A boat lands 3.1875 tonnes.", "code", "3.1875", expectations, attempts=[(1, "a", True, "3.1875"), (2, "b", False, "")], verified=False
    )
    assert {k for k, (ok, _) in found.items() if ok} == {"executed", "repairs_at_most 1.0", "reports_value 3.1875", "no_invented_numbers"}
    assert "routed to 'code'" in found["checks_pass"][1]
    silent = grade(spark, "Some 8", "code", None, expectations[:3] + [("no_invented_numbers",)], attempts=[(1, "a", False, "")])
    assert not any(ok for name, (ok, _) in silent.items() if name != "repairs_at_most 1.0")
    assert grade(spark, "x", expectations=expectations, error="timeout") == {}


def test_report(spark, tmp_path):
    rows = []
    for model, cases in (("big", {"a": (2, 2), "b": (2, 2)}), ("small", {"a": (2, 1), "b": (0, 0)})):
        for case, scores in cases.items():
            for attempt, score in enumerate(scores, 1):
                rows += [(case, model, attempt, "routing" if i == 0 else "correctness", f"t{i}", i < score, "d") for i in range(2)]
    results = spark.createDataFrame(rows, "case_id string, model string, attempt int, family string, assertion string, passed boolean, detail string")
    runs = spark.createDataFrame(
        [(c, m, t, "change", 10.0 * t, 7, None, "text") for c in "ab" for m in ("big", "small") for t in (1, 2)] + [("a", "down", 1, "", 3.0, 0, "timeout", "")],
        "case_id string, model string, attempt int, route string, seconds double, output_tokens int, error string, narrative string",
    )
    report = {k: [r.asDict() for r in v.collect()] for k, v in eval_report(results, runs).items()}
    scores = {r["model"]: r for r in report["scores"]}
    assert scores["big"]["pct"] == 100 and scores["small"]["passed"] == 3 and scores["small"]["median_seconds"] == 15.0
    assert scores["down"]["passed"] is None and scores["down"]["median_seconds"] is None
    families = {r["model"]: r for r in report["families"]}
    late = runs.withColumn("error", F.when((F.col("model") == "small") & (F.col("attempt") == 2), F.lit("timeout")).otherwise(F.col("error")))
    aside = {k: [r.asDict() for r in v.collect()] for k, v in eval_report(results, late.withColumn("seconds", F.col("seconds") + 0.004)).items()}
    scores = {r["model"]: r for r in aside["scores"]}
    assert (scores["small"]["passed"], scores["small"]["total"], scores["small"]["median_seconds"]) == (2, 4, 10.004)
    assert {r["model"]: r["passes"] for r in aside["variance"]} == {"big": 2, "small": 1} and aside["unstable"] == []
    assert {(r["case_id"], r["runs"]) for r in aside["cases"] if r["model"] == "small"} == {("a", 1), ("b", 1)}
    assert families["small"]["routing"] == 50 and families["small"]["correctness"] == 25 and families["small"]["communication"] is None
    variance = {r["model"]: r for r in report["variance"]}
    assert variance["big"]["sd"] == 0 and variance["small"]["worst_pct"] == 25 and variance["small"]["sd"] == pytest.approx(17.6777, abs=1e-3)
    assert [(r["model"], r["case_id"]) for r in report["unstable"]] == [("small", "a")]
    assert report["failures"][0]["failures"] == 3 and not report["gate"][0]["ok"]
    usage = {r["model"]: r for r in report["usage"]}
    assert usage["big"]["calls"] == 4 and usage["big"]["tokens_per_second"] == pytest.approx(28 / 60)
    write_run_records(runs, results, str(tmp_path / "runs.json"))
    back = spark.read.schema(run_records(runs, results).schema).json(str(tmp_path / "runs.json"))
    worst = back.filter("model = 'small' AND `case` = 'b' AND attempt = 1").first()
    assert worst["passed"] == 0 and [f["name"] for f in worst["failures"]] == ["t1", "t0"]


def test_failure_runs_across_chunks(spark, monkeypatch):
    """Against a plain loop, with chunks so small that runs span several levels of them."""
    monkeypatch.setattr(g, "CHUNK", 3)
    import random

    rng = random.Random(5)
    rows, longest = [], {}
    for answer in range(6):
        run = best = 0
        for step in range(rng.choice([1, 5, 40, 100])):
            ok = rng.random() > 0.8 if answer % 2 else rng.random() > 0.3
            run = 0 if ok else run + 1
            best = max(best, run)
            rows.append((answer, step * 2, "x", ok, ""))
        longest[answer] = best
    attempts = spark.createDataFrame(rows, "answer_id int, step int, code string, ok boolean, output string").repartition(5)
    assert {r["answer_id"]: r["longest_failure_run"] for r in g.longest_failure_runs(attempts).collect()} == longest
