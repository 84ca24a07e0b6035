"""Boundaries of the decision rules, formats, merges, the monitor and the streams."""

import pytest
from pyspark.sql import functions as F

from credit_engine.functions import columns as C
from credit_engine.operators import catalog, decision, monitor
from credit_engine.streaming import payments


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("score", "want"), [(70.01, "Approve"), (70.0, "Review"), (50.01, "Review"), (50.0, "Reject")])
def test_label(spark, score, want):
    assert one(spark, C.label(F.lit(score))) == want


@pytest.mark.parametrize(("drop", "want"), [(10.0, 0.0), (10.01, 15.0), (None, 0.0)])
def test_penalty(spark, drop, want):
    assert one(spark, C.drop_penalty(F.lit(drop).cast("double"))) == want


@pytest.mark.parametrize(("rate", "want"), [(12.0, False), (12.5, True), (None, False)])
def test_rate_warning(spark, rate, want):
    assert one(spark, C.is_high_rate(F.lit(rate).cast("double"))) is want


@pytest.mark.parametrize(
    ("amount", "want"),
    [(0, "₹ 0"), (999, "₹ 999"), (1000, "₹ 1,000"), (100000, "₹ 1,00,000"), (2500000, "₹ 25,00,000"), (12345678, "₹ 1,23,45,678"), (-0.9, "₹ 0"), (-100, "₹ -,100"), (-12345, "₹ -,12,345"), (-1234567, "₹ -,12,34,567")],
)
def test_format_inr(spark, amount, want):
    assert one(spark, C.format_inr(F.lit(float(amount)))) == want


@pytest.mark.parametrize(("rate", "growth", "score", "label", "codes"), [
    (8.5, 15.0, 88, "APPROVED", ["within_thresholds"]), (24.0, 100.0, 74, "REJECTED", ["high_rate"]), (15.0, -10.0, 70, "APPROVED", ["early_warning"]),
    (4.0, 100.0, 99, "APPROVED", ["within_thresholds"]), (24.0, -50.0, 44, "REJECTED", ["high_rate", "early_warning"]),
])
def test_simulator(spark, rate, growth, score, label, codes):
    i, g = F.lit(rate), F.lit(growth)
    row = spark.range(1).select(C.simulated_score(i, g).alias("s"), C.simulated_decision(i, g).alias("d"), C.simulated_insights(i, g).alias("c")).first()
    assert (row.s, row.d, row.c) == (score, label, codes)


def test_override(spark):
    base, params = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)), F.create_map(F.lit("a"), F.lit(1), F.lit("c"), F.lit(9))
    assert one(spark, C.override(base, params)) == {"a": 1, "b": 3, "c": 9}
    assert one(spark, C.override(base, F.create_map(F.lit("a"), F.lit(None).cast("int")))) == {"a": None, "b": 3}


def test_clamp_keeps_null(spark):
    assert one(spark, C.clamp(F.lit(None).cast("double"))) is None


def test_mean_of_six(spark):
    rows = catalog.agents(spark).filter("in_mean").withColumn("k", F.lit(1))
    row = decision.decide(rows, ["k"]).first()
    assert (row.mean_score, row.decision) == (83.0, "Approve")


def state(spark, log):
    return monitor.status(log.to_df(spark)).first()


def test_log_of_runs(spark):
    log = monitor.RunLog()
    assert tuple(state(spark, log)) == ("Initialized", [], None, None, 0, 0.0, "Healthy")
    log.add("begin")
    assert state(spark, log).current_stage == "Starting"
    log.add("enter", "A")
    s = state(spark, log)
    assert (s.current_stage, s.running_stage, s.completed_stages) == ("A", "A", [])
    log.add("leave", "A")
    s = state(spark, log)
    assert (s.current_stage, s.running_stage, s.completed_stages) == ("A", None, ["A"])
    log.add("end")
    assert state(spark, log).current_stage == "Completed"
    assert monitor.run_stages(log, [("B", lambda x: x + 1), ("C", lambda x: 2 * x)], 3) == 8
    s = state(spark, log)  # of both runs
    assert (s.current_stage, s.completed_stages, s.pipeline_health, s.failed_stage) == ("Completed", ["A", "B", "C"], "Healthy", None) and s.execution_time_ms >= 0
    with pytest.raises(ZeroDivisionError):
        monitor.run_stages(log, [("D", lambda x: x / 0)], 1)
    s = state(spark, log)
    assert (s.current_stage, s.failed_stage, s.running_stage, len(s.completed_stages), s.pipeline_health) == ("Failed", "D", None, 3, "Failed")
    left = [0, 1]  # the first attempt divides by zero, the second one does not
    assert monitor.run_stages(log, [("E", lambda x: x // (1 - left.pop()))], 5, retries=2) == 5
    s = state(spark, log)
    assert (s.current_stage, s.pipeline_health, s.retry_count, s.completed_stages[-1]) == ("Completed", "Degraded", 1, "E")


def test_retry_degrades_and_completes(spark):
    log, answers = monitor.RunLog(), iter([1 / 3, None, 7])

    def flaky(_):
        x = next(answers)
        if x != 7:
            raise OSError("again")
        return x

    assert monitor.run_stages(log, [("A", flaky)], None, retries=2) == 7
    s = state(spark, log)
    assert (s.current_stage, s.pipeline_health, s.retry_count, s.failed_stage, s.completed_stages) == ("Completed", "Degraded", 2, "A", ["A"])


def test_last_answer_counts(spark):
    rows = [(1, "a", 5.0, 1), (1, "a", 3.0, 2), (1, "b", 4.0, 1), (1, "b", 6.0, 1), (2, "a", None, 1)]
    got = {r.k: r.results for r in decision.collect_last(spark.createDataFrame(rows, "k long, agent_name string, score double, round int"), ["k"], "round").collect()}
    assert got == {1: {"a": 3.0, "b": 6.0}, 2: {"a": None}}


def test_warning_is_appended(spark):
    given = F.array(F.lit("x"))
    assert one(spark, C.with_rate_warning(given, F.lit(12.5))) == ["x", C.RATE_WARNING] and one(spark, C.with_rate_warning(given, F.lit(12.0))) == ["x"]
    assert one(spark, C.default(F.create_map(F.lit("a"), F.lit(2)), "a")) == 2.0 and one(spark, C.default(F.create_map(F.lit("a"), F.lit(2)), "b")) == 0.0


def test_too_many_scenarios(spark, monkeypatch):
    monkeypatch.setattr(decision, "MOST_SCENARIOS", 3)
    with pytest.raises(ValueError, match="scenarios"):
        decision.stress(spark.createDataFrame([(1, 60.0)], "id long, mean_score double"), catalog.scenarios(spark))


def test_each_scenario(spark):
    few = spark.createDataFrame([("a", 1.5, None), ("b", None, [1, 2])], "name string, `x y` double, z array<int>")
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(str, decision.with_each(rows, few).collect())) == sorted(map(str, rows.crossJoin(few).collect()))
    assert decision.with_each(rows, few.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["coordinator_grid", "scenario_invariance", "scenario_stress", "process_documents"])
def test_nothing_is_crossed(spark, sf_dir, name):
    import __spark_entry__ as e

    plan = e.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intake(spark):
    from credit_engine.sources.tables import intake

    rows = [(1, "A", "BUILDING", 5.0, True), (2, "B", "CIRCUS", 5.0, True), (3, "C", "BUILDING", 5.0, False), (4, " ", "BUILDING", 5.0, True), (5, "D", None, 5.0, None), (6, "E", "BUILDING", 5.0, None)]
    rows += [(7, "F", "BUILDING", None, True), (8, "G", "BUILDING", float("nan"), True), (9, "H", "BUILDING", 0.0, True)]
    got = [r.status for r in intake(spark.createDataFrame(rows, "applicant_id long, name string, industry string, annual_revenue double, consent boolean"), catalog.INDUSTRIES).orderBy("applicant_id").collect()]
    assert got == ["accepted", "unknown_industry", "no_consent", "missing_field", "missing_field", "no_consent", "missing_field", "missing_field", "no_revenue"]


def test_what_is_not_a_number_is_missing(spark):
    nan, nothing = F.lit(float("nan")), F.lit(None).cast("double")
    for x in (nan, nothing):
        assert [one(spark, c) for c in (C.clamp(x), C.label(x), C.cents(x), C.round2(C.known(x)))] == [None] * 4
        assert one(spark, C.drop_penalty(x)) == 0.0 and one(spark, C.is_high_rate(x)) is False
    assert one(spark, C.clamp(F.lit(float("inf")))) == 100.0 and one(spark, C.known(F.lit(3))) == 3.0
    scores = spark.createDataFrame([("a", float("nan")), ("b", 60.0)], "agent_name string, score double").withColumn("k", F.col("agent_name"))
    assert {r.k: r.decision for r in decision.decide(scores, ["k"]).collect()} == {"a": None, "b": "Review"}


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


def test_documents_that_cannot_be_read_fail_their_stage(spark, small, tmp_path):
    from pathlib import Path

    from credit_engine.plans import lending

    for p in Path(small).iterdir():
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "documents.parquet").unlink()
    (tmp_path / "documents.parquet").write_text("no table")
    log = monitor.RunLog()
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        lending.workflow(spark, str(tmp_path), log)
    s = state(spark, log)
    assert (s.current_stage, s.failed_stage, s.completed_stages, s.pipeline_health) == ("Failed", "Document Pipeline", [], "Failed")


def test_reports_are_computed_once(spark, small):
    """What processing returns is read from the written reports."""
    from credit_engine.plans import lending

    log = monitor.RunLog()
    made, numbers = lending.workflow(spark, small, log)
    assert numbers["n_reports"] == made.count() == 150 and numbers["n_documents"] == numbers["n_verified"] + numbers["n_warning"] + numbers["n_failed"]
    plan = lending.process_documents(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "l_orderkey" not in plan
    row = made.orderBy("applicant_id").first().report
    assert set(row.timeline.asDict()) == {"revenue", "expense", "cash_flow", "gst", "business_growth", "upi", "payroll"} and row.timeline.upi
    assert set(row.decision_confidence.factors) == {"agreement", "document_quality", "history", "completeness"}


def test_scenarios_change_the_offer(spark, small):
    from credit_engine.plans import lending

    rows = {(r.applicant_id, r.scenario): r for r in lending.scenario_reports(spark, small).collect()}
    assert len(rows) == 600
    hit = [(rows[i, "base"], rows[i, "drop"]) for i, s in rows if s == "base" and rows[i, "drop"].decision != rows[i, "base"].decision]
    assert hit and all(a.base_decision == a.decision and b.base_decision == a.decision and a.overall_health_score == round(b.overall_health_score + 15, 2) for a, b in hit)
    assert all(r.suggestions.endswith(C.RATE_WARNING) == (s in ("rate", "both")) for (_, s), r in rows.items())
    assert all(r.principal_inr == "₹ 0" and r.repayment_capacity == "none" and r.risk_level == "High" for r in rows.values() if r.decision == "Reject")


def test_closed_sessions_equal_table(spark, sf_dir):
    from credit_engine.sources.tables import payments as table

    closed = payments.append(payments.sessions(payments.read_stream(spark, sf_dir)))
    every = payments.sessions(table(spark, sf_dir))
    assert closed.exceptAll(every).isEmpty()
    end = table(spark, sf_dir).agg(F.max("ts")).first()[0]
    over = every.filter(F.col("started").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, micros / 1000000)") < F.lit(end) - F.expr("INTERVAL 1 DAY 1 HOUR"))
    assert over.exceptAll(closed).isEmpty() and over.count() > 0


def test_ledger_is_read_once(spark, sf_dir):
    from credit_engine.plans import lending

    plan = lending.full_report(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 1 and plan.count("Relation [l_orderkey") == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 150
