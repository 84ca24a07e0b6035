"""Fixed values that results must equal, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Agent, score, confidence, number of suggestions, whether it counts in the mean.
AGENTS = [
    ("Financial Health", 85.0, 0.92, 2, True),
    ("Cash Flow", 70.0, 0.88, 2, True),
    ("Fraud Risk", 12.0, 0.95, 1, True),
    ("Forecast", 82.0, 0.85, 1, True),
    ("Compliance", 98.0, 0.99, 1, True),
    ("Business Stability", 75.0, 0.89, 1, True),
    ("Recommendation", 90.0, 0.94, 2, False),
]
# Series, period (DD/MM/YYYY), value.
TIMELINE = [
    ("revenue", "01/01/2023", 500000.0), ("revenue", "01/02/2023", 550000.0),
    ("expense", "01/01/2023", 300000.0), ("expense", "01/02/2023", 320000.0),
    ("cash_flow", "01/01/2023", 200000.0), ("cash_flow", "01/02/2023", 230000.0),
    ("gst", "01/01/2023", 90000.0), ("gst", "01/02/2023", 99000.0),
    ("payroll", "01/01/2023", 150000.0), ("payroll", "01/02/2023", 150000.0),
    ("upi", "01/01/2023", 250000.0), ("upi", "01/02/2023", 280000.0),
    ("business_growth", "01/01/2023", 1.0), ("business_growth", "01/02/2023", 1.1),
]
# Feature, impact, direction.
ATTRIBUTION = [("Revenue Growth", 0.45, "positive"), ("Debt Ratio", 0.25, "negative"), ("Operating Margin", 0.30, "positive")]
# The constant report, field by field. Amounts are rupees.
REPORT = {
    "financial_health_score": 85.0, "cash_flow_score": 80.0, "compliance_score": 90.0, "fraud_risk_score": 10.0,
    "business_stability_score": 88.0, "forecast_score": 82.0, "decision_confidence": "High", "decision_confidence_score": 0.88,
    "verification_status": "Verified", "verification_confidence": 0.98, "recommended_amount": 2500000.0, "maximum_amount": 3500000.0,
    "interest_range": "9.5% - 11.5% p.a.", "tenure": "36 months", "emi": 80200.0, "repayment_capacity": "Strong Working Capital", "risk_level": "Low",
}
#: Own texts for the four coaching rules, by the agent whose weak score calls for them.
COACHING = [
    ("Compliance", "file_returns_on_time"),
    ("Business Stability", "complete_registration"),
    ("Cash Flow", "raise_average_balance"),
    ("Financial Health", "lower_emi_to_revenue"),
]
#: Own codes for what is suggested with any offer.
OFFER_TEXTS = ("offer_amount", "offer_rate")
#: Own codes for the agents' reasons, by agent.
REASONS = [
    ("Financial Health", "leverage_and_growth"),
    ("Cash Flow", "positive_but_volatile"),
    ("Fraud Risk", "no_anomalies"),
    ("Forecast", "revenue_projected_to_grow"),
    ("Compliance", "filings_current"),
    ("Business Stability", "low_churn_few_clients"),
    ("Recommendation", "capacity_to_repay"),
]
#: Agents whose reasons are shown as cards.
CARDS = ("Financial Health", "Fraud Risk", "Forecast")
# The stages of the workflow, in order.
STAGES = ("Document Pipeline", "Financial Pipeline", "Feature Pipeline", "AI Pipeline", "Decision Pipeline", "Recommendation Pipeline", "Reporting Pipeline")
# Nodes and edges of the drawn stage graph.
NODES = [("1", "Financial Data"), ("2", "Feature Engineering"), ("3", "Health Agent"), ("4", "Fraud Agent"), ("5", "Forecast Agent"), ("6", "Decision Coordinator")]
EDGES = [("1", "2"), ("2", "3"), ("2", "4"), ("2", "5"), ("3", "6"), ("4", "6"), ("5", "6")]
# Slider, least, greatest, step.
SLIDERS = [("loan_amount", 10000.0, 250000.0, 5000.0), ("interest_rate", 4.0, 24.0, 0.5), ("revenue_growth", -50.0, 100.0, 1.0), ("cash_flow_change", -30.0, 30.0, 1.0)]
#: Industries that the intake takes, and the sources that it imports.
INDUSTRIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")
#: Scenarios that decisions are stressed with: name, revenue drop, interest rate.
SCENARIOS = [("base", 0.0, 9.5), ("drop", 15.0, 9.5), ("rate", 0.0, 14.0), ("both", 15.0, 14.0)]


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AGENTS, "agent_name string, score double, confidence double, n_suggestions int, in_mean boolean")


def timeline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIMELINE, "series string, period string, value double")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, revenue_drop double, interest_rate double")


def coaching(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COACHING, "agent_name string, tip string")


def reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASONS, "agent_name string, reason string")
