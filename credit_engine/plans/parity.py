"""Queries whose results are the reference's own: fixed tables, aggregation rules, simulator formulas, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import catalog, decision
from ..sources import tables


def coordinator_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six agents' mean under every drop 0..20 and rate 8..16."""
    grid = spark.range(21).select(F.col("id").cast("double").alias("revenue_drop"), F.explode(F.sequence(F.lit(8), F.lit(16)).cast("array<double>")).alias("interest_rate"))
    scored = catalog.agents(spark).filter("in_mean").select("agent_name", "score", F.lit(1).alias("one"))
    base = decision.decide(scored, ["one"]).drop("one")
    return decision.stress(base, grid).select("revenue_drop", "interest_rate", "overall_health_score", F.col("stressed_decision").alias("decision"), "n_suggestions")


def _grid(spark: SparkSession) -> DataFrame:
    """Rates 4..24 by a half and growths -50..100 by one."""
    return spark.range(41).select((4.0 + F.col("id") * 0.5).alias("interest_rate"), F.explode(F.sequence(F.lit(-50), F.lit(100)).cast("array<double>")).alias("revenue_growth"))


def simulator_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, g = F.col("interest_rate"), F.col("revenue_growth")
    return _grid(spark).select(i, g, C.simulated_score(i, g).alias("score"), C.simulated_decision(i, g).alias("decision"))


def simulator_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, g = F.col("interest_rate"), F.col("revenue_growth")
    return _grid(spark).select(i, g, F.explode(C.simulated_insights(i, g)).alias("insight"))


#: Amounts at the edges of the format.
EDGES = (0.0, 999.0, 1000.0, 99999.0, 100000.0, 2500000.0, 12345678.0, -0.9, -100.0, -12345.0, -1234567.0, 2.9)


def inr_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    edges = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(EDGES)], "id bigint, amount double")
    return orders.unionByName(edges).select("id", C.format_inr(F.col("amount")).alias("formatted"))


def scenario_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of base values for each applicant with a scenario's values laid over it."""
    base = F.create_map(F.lit("loan_amount"), F.round(F.abs("balance") * 10.0, 2), F.lit("interest_rate"), F.lit(9.5))
    params = F.create_map(F.lit("interest_rate"), F.lit(14.0), F.lit("revenue_drop"), F.when(F.col("applicant_id") % 2 == 0, 15.0))
    return tables.applicants(spark, sf_dir).select("applicant_id", F.explode(C.override(base, params)).alias("parameter", "value"))


def timeline_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.timeline(spark).select("series", F.to_date("period", "dd/MM/yyyy").alias("month"), "value")


def agent_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.agents(spark).withColumn("effective_score", C.effective_score(F.col("agent_name"), F.col("score")))


def attribution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(catalog.ATTRIBUTION, "feature string, impact double, direction string")


def slider_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each slider takes, and which are the least and the greatest."""
    sliders = spark.createDataFrame(catalog.SLIDERS, "slider string, low double, high double, step double")
    steps = sliders.select("slider", "low", "step", F.explode(F.sequence(F.lit(0), F.round((F.col("high") - F.col("low")) / F.col("step")).cast("int"))).alias("i"))
    value = F.col("low") + F.col("i") * F.col("step")
    return steps.groupBy("slider").agg(F.count("*").alias("n_values"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def stage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the drawn stage graph with the edges that come in and go out."""
    nodes, edges = spark.createDataFrame(catalog.NODES, "id string, label string"), spark.createDataFrame(catalog.EDGES, "source string, target string")
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("comes"), F.lit(1).alias("goes")).unionByName(edges.select(F.col("target").alias("id"), F.lit(1).alias("comes"), F.lit(0).alias("goes")))
    degrees = ends.groupBy("id").agg(F.sum("comes").alias("in_degree"), F.sum("goes").alias("out_degree"))
    return nodes.join(degrees, "id", "left").select("id", "label", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def scenario_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant report of every scenario: modifiers do not touch it, so there is one distinct report."""
    every = decision.with_each(report_constant(spark, sf_dir), catalog.scenarios(spark))
    rows = every.groupBy(*[c for c in every.columns if c not in ("scenario", "revenue_drop", "interest_rate")]).agg(F.count("*").alias("n_scenarios"))
    return rows.agg(F.count("*").alias("distinct_reports"), F.sum("n_scenarios").alias("n_scenarios"))


def report_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in catalog.REPORT.items()])
    amounts = {f"{c}_inr": C.format_inr(F.col(c)) for c in ("recommended_amount", "maximum_amount", "emi")}
    return row.withColumns(amounts | {"n_tips": F.lit(len(catalog.COACHING))})


_INR = """CASE WHEN length(x) <= 3 THEN '₹ ' || x ELSE '₹ ' || reverse(rtrim(regexp_replace(reverse(left(x, length(x) - 3)), '(..)', '\\1,', 'g'), ',')) || ',' || right(x, 3) END"""
_SIM = "SELECT 4.0::DOUBLE + i * 0.5::DOUBLE AS interest_rate, g::DOUBLE AS revenue_growth FROM range(41) a(i), range(-50, 101) b(g)"


ORACLES = {
    "coordinator_grid": """
        WITH m AS (SELECT (85 + 70 + (100 - 12) + 82 + 98 + 75)::DOUBLE / 6 AS mean)
        SELECT d::DOUBLE AS revenue_drop, i::DOUBLE AS interest_rate, round(mean - CASE WHEN d > 10 THEN 15 ELSE 0 END, 2) AS overall_health_score,
               CASE WHEN mean - CASE WHEN d > 10 THEN 15 ELSE 0 END > 70 THEN 'Approve' WHEN mean - CASE WHEN d > 10 THEN 15 ELSE 0 END > 50 THEN 'Review' ELSE 'Reject' END AS decision,
               CAST(CASE WHEN i > 12 THEN 3 ELSE 2 END AS INTEGER) AS n_suggestions
        FROM m, range(21) a(d), range(8, 17) b(i)""",
    "simulator_grid": f"""
        SELECT interest_rate, revenue_growth, CAST(round(greatest(10, least(99, 85 + revenue_growth / 5 - (interest_rate - 8.5::DOUBLE) * 2))) AS BIGINT) AS score,
               CASE WHEN interest_rate > 15 OR revenue_growth < -10 THEN 'REJECTED' ELSE 'APPROVED' END AS decision FROM ({_SIM})""",
    "simulator_insights": f"""
        WITH s AS ({_SIM})
        SELECT *, 'high_rate' AS insight FROM s WHERE interest_rate > 15 UNION ALL SELECT *, 'early_warning' FROM s WHERE revenue_growth < 0
        UNION ALL SELECT *, 'within_thresholds' FROM s WHERE interest_rate <= 15 AND revenue_growth >= 0""",
    "inr_format": f"""
        WITH a AS (SELECT o_orderkey AS id, o_totalprice AS amount FROM orders UNION ALL SELECT * FROM (VALUES
          (-1, 0.0::DOUBLE), (-2, 999.0), (-3, 1000.0), (-4, 99999.0), (-5, 100000.0), (-6, 2500000.0), (-7, 12345678.0), (-8, -0.9), (-9, -100.0), (-10, -12345.0), (-11, -1234567.0), (-12, 2.9))),
        t AS (SELECT id, CAST(CAST(trunc(amount) AS BIGINT) AS VARCHAR) AS x FROM a)
        SELECT id, {_INR} AS formatted FROM t""",
    "scenario_override": """
        SELECT c_custkey AS applicant_id, 'loan_amount' AS parameter, round(abs(c_acctbal) * 10, 2) AS value FROM customer
        UNION ALL SELECT c_custkey, 'interest_rate', 14.0::DOUBLE FROM customer
        UNION ALL SELECT c_custkey, 'revenue_drop', CASE WHEN c_custkey % 2 = 0 THEN 15.0::DOUBLE END FROM customer""",
    "timeline_constant": """
        SELECT series, make_date(2023, month, 1) AS month, value::DOUBLE AS value FROM (VALUES
          ('revenue', 1, 500000), ('revenue', 2, 550000), ('expense', 1, 300000), ('expense', 2, 320000), ('cash_flow', 1, 200000), ('cash_flow', 2, 230000), ('gst', 1, 90000), ('gst', 2, 99000),
          ('payroll', 1, 150000), ('payroll', 2, 150000), ('upi', 1, 250000), ('upi', 2, 280000), ('business_growth', 1, 1.0), ('business_growth', 2, 1.1)) t(series, month, value)""",
    "agent_catalog": """
        SELECT agent_name, score::DOUBLE AS score, confidence::DOUBLE AS confidence, n_suggestions, in_mean, effective_score::DOUBLE AS effective_score FROM (VALUES
          ('Financial Health', 85, 0.92, 2, true, 85), ('Cash Flow', 70, 0.88, 2, true, 70), ('Fraud Risk', 12, 0.95, 1, true, 88), ('Forecast', 82, 0.85, 1, true, 82), ('Compliance', 98, 0.99, 1, true, 98),
          ('Business Stability', 75, 0.89, 1, true, 75), ('Recommendation', 90, 0.94, 2, false, 90)) t(agent_name, score, confidence, n_suggestions, in_mean, effective_score)""",
    "attribution_rows": "SELECT feature, impact::DOUBLE AS impact, direction FROM (VALUES ('Revenue Growth', 0.45, 'positive'), ('Debt Ratio', 0.25, 'negative'), ('Operating Margin', 0.30, 'positive')) t(feature, impact, direction)",
    "report_constant": """
        SELECT 85.0::DOUBLE AS financial_health_score, 80.0::DOUBLE AS cash_flow_score, 90.0::DOUBLE AS compliance_score, 10.0::DOUBLE AS fraud_risk_score, 88.0::DOUBLE AS business_stability_score, 82.0::DOUBLE AS forecast_score,
               'High' AS decision_confidence, 0.88::DOUBLE AS decision_confidence_score, 'Verified' AS verification_status, 0.98::DOUBLE AS verification_confidence, 2500000.0::DOUBLE AS recommended_amount,
               3500000.0::DOUBLE AS maximum_amount, '9.5% - 11.5% p.a.' AS interest_range, '36 months' AS tenure, 80200.0::DOUBLE AS emi, 'Strong Working Capital' AS repayment_capacity, 'Low' AS risk_level,
               '₹ 25,00,000' AS recommended_amount_inr, '₹ 35,00,000' AS maximum_amount_inr, '₹ 80,200' AS emi_inr, 4 AS n_tips""",
    "slider_domains": """
        SELECT slider, n_values::BIGINT AS n_values, least::DOUBLE AS least, greatest::DOUBLE AS greatest
        FROM (VALUES ('loan_amount', 49, 10000, 250000), ('interest_rate', 41, 4, 24), ('revenue_growth', 151, -50, 100), ('cash_flow_change', 61, -30, 30)) t(slider, n_values, least, greatest)""",
    "stage_graph": """
        SELECT id, label, in_degree::BIGINT AS in_degree, out_degree::BIGINT AS out_degree FROM (VALUES ('1', 'Financial Data', 0, 1), ('2', 'Feature Engineering', 1, 3), ('3', 'Health Agent', 1, 1), ('4', 'Fraud Agent', 1, 1),
          ('5', 'Forecast Agent', 1, 1), ('6', 'Decision Coordinator', 3, 0)) t(id, label, in_degree, out_degree)""",
    "scenario_invariance": "SELECT 1::BIGINT AS distinct_reports, 4::BIGINT AS n_scenarios",
}
QUERIES = {f.__name__: f for f in (coordinator_grid, simulator_grid, simulator_insights, inr_format, scenario_override, timeline_constant, agent_catalog, attribution_rows, report_constant, slider_domains, stage_graph, scenario_invariance)}
