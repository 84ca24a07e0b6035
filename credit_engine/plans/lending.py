"""Queries that the lending demo only promises: data-driven timelines, scores, decisions and reports. Their SQL is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import catalog, decision, monitor, profile
from ..sources import tables
from ..storage import materialize
from ..streaming import payments as stream


CONFIDENCE_FACTORS = ("agreement", "document_quality", "history", "completeness")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.features(tables.applicants(spark, sf_dir), tables.ledger(spark, sf_dir), tables.payments(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.scored(_wide(spark, sf_dir))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each applicant with all that is decided on it; Spark leaves out what a query does not use."""
    return decision.assess(_scored(spark, sf_dir))


def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("applicant_id", C.round2(F.col("mean_score")).alias("overall_health_score"), "decision")


def monthly_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.growth(profile.monthly(tables.ledger(spark, sf_dir)))


def cashflow_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cash = F.col("revenue") - F.col("expense") - F.col("tax")
    return profile.monthly(tables.ledger(spark, sf_dir)).select("applicant_id", "month", *[C.amount(F.col(c)).alias(c) for c in ("revenue", "expense", "tax")], C.amount(cash).alias("cash_flow"))


def gst_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tax_filings(tables.ledger(spark, sf_dir))


def _upi(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = tables.payments(spark, sf_dir).filter("event_type = 'purchase'")
    return paid.groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("month")).agg(C.amount(F.sum("paid")).alias("upi"))


def series_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = tables.ledger(spark, sf_dir).groupBy("month").agg(C.amount(F.sum("revenue")).alias("revenue"))
    return revenue.join(_upi(spark, sf_dir), "month", "full_outer")


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.features_long(_wide(spark, sf_dir))


def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features each of an applicant's nine groups holds; that of payroll none."""
    maps = _wide(spark, sf_dir).select("applicant_id", profile.feature_maps().alias("m"))
    names = maps.schema["m"].dataType.names
    sizes = F.array(*[F.struct(F.lit(n).alias("feature_group"), F.size(F.col("m")[n]).cast("bigint").alias("n")) for n in names])
    return maps.select("applicant_id", F.inline(sizes))


def agent_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.agent_scores(_wide(spark, sf_dir)).drop("industry")


def agent_results_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of agents' scores after Cash Flow and Forecast were asked again and more strictly: the later answer counts."""
    first = profile.agent_scores(_wide(spark, sf_dir)).select("applicant_id", "agent_name", "score", F.lit(1).alias("round"))
    again = first.filter(F.col("agent_name").isin("Cash Flow", "Forecast")).select("applicant_id", "agent_name", (F.col("score") / 2.0).alias("score"), F.lit(2).alias("round"))
    kept = decision.collect_last(first.unionByName(again), ["applicant_id"], "round")
    return kept.select("applicant_id", F.explode("results").alias("agent_name", "score"))


def decision_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banded share of agents on the decision's side of 50, and the factors beside it."""
    parts = [F.col("confidence_factors")[c].alias(c) for c in CONFIDENCE_FACTORS]
    return _assessed(spark, sf_dir).select("applicant_id", "confidence", "confidence_level", *parts)


def scenario_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    stressed = decision.stress(_assessed(spark, sf_dir).select("applicant_id", "mean_score"), catalog.scenarios(spark))
    return stressed.select("applicant_id", "scenario", "overall_health_score", F.col("stressed_decision").alias("decision"), "n_suggestions")


def scenario_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suggestions of every scenario in their order, the warning of a high rate last."""
    stressed = decision.stress(_assessed(spark, sf_dir).select("applicant_id", "mean_score"), catalog.scenarios(spark))
    return stressed.select("applicant_id", "scenario", F.posexplode("suggestions").alias("place", "suggestion"))


def scenario_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of every applicant under every scenario, flattened; its own decision beside the unstressed one."""
    stressed = decision.restress(decision.judge(_scored(spark, sf_dir)), catalog.scenarios(spark))
    reported = stressed.select("applicant_id", "scenario", "base_decision", decision.report())
    return _flat(reported, "scenario", "base_decision")


def label_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    stressed = decision.stress(_assessed(spark, sf_dir).select("applicant_id", "mean_score", "decision"), catalog.scenarios(spark))
    return stressed.groupBy("scenario", F.col("decision").alias("from_decision")).pivot("stressed_decision", ["Approve", "Review", "Reject"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed(
        {"Approve": "to_approve", "Review": "to_review", "Reject": "to_reject"}
    )


def loan_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six months' average revenue over 36 months, capped by the cash flow; with the payment's share of a month."""
    return _assessed(spark, sf_dir).select("applicant_id", "decision", "principal", "interest_rate", "emi", "principal_inr", "capped", "payment_share", "maximum_principal", "rate_high", "repayment_capacity", "risk_level")


def portfolio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).rollup("industry", "decision").agg(
        F.grouping("industry").cast("bigint").alias("all_industries"), F.grouping("decision").cast("bigint").alias("all_decisions"), F.count("*").alias("n"),
        C.amount(F.sum(C.cents(F.col("revenue")))).alias("revenue"),
    )


def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications, share approved, and revenue of those whose returns look like fraud."""
    flagged = F.when(F.coalesce("return_rate", F.lit(0.0)) > 0.5, C.cents(F.col("revenue")))
    return _assessed(spark, sf_dir).agg(F.count("*").alias("applications"), F.round(F.avg((F.col("decision") == "Approve").cast("double")), 6).alias("approval_rate"), F.coalesce(C.amount(F.sum(flagged)), F.lit(0.0)).alias("flagged_revenue"))


def top_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst of each industry; Spark keeps ten of each before it shuffles."""
    worst = F.row_number().over(W.partitionBy("industry").orderBy("mean_score", "applicant_id"))
    return _assessed(spark, sf_dir).select("industry", "applicant_id", "mean_score", worst.alias("rank")).filter("rank <= 10").select("industry", "rank", "applicant_id", C.round2(F.col("mean_score")).alias("overall_health_score"))


def company_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What registering a company returns: success, its id and its name."""
    return tables.applicants(spark, sf_dir).select(F.lit("success").alias("status"), F.concat(F.lit("CMP-"), F.col("applicant_id")).alias("company_id"), "name")


def company_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.intake(tables.company_forms(spark, sf_dir), catalog.INDUSTRIES).drop("applicant_id")


def import_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources after an import, each with its rows: tax filings, digital payments, bank ledger."""
    ledger = tables.ledger(spark, sf_dir)
    sources = {"gst": tables.tax_filings(ledger), "upi": tables.payments(spark, sf_dir).filter("event_type = 'purchase'"), "banking": ledger}
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("source"), "n_rows") for name, df in sources.items()]
    rows = counted[0].unionByName(counted[1]).unionByName(counted[2])
    return rows.select("source", F.when(F.col("n_rows") > 0, "done").otherwise("idle").alias("state"), "n_rows")


def doc_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("quality").isNull(), "Warning").when((F.col("quality") == 1) & (F.col("toxic") == 0), "Verified").otherwise("Failed")
    return docs.join(labels, "doc_id", "left").groupBy("source", status.alias("status")).agg(F.count("*").alias("n"))


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("bigint").alias("length"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint").alias("line_breaks"), F.contains(F.lower(text), F.lit("license")).alias("mentions_license"))


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    bare = orders.join(lines, "id", "left_anti").select(F.lit("order_without_lines").alias("issue"), "id")
    negative = tables.applicants(spark, sf_dir).filter("balance < 0").select(F.lit("negative_balance").alias("issue"), F.col("applicant_id").alias("id"))
    return bare.unionByName(negative)


def payment_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events more than three deviations from their user's mean; a user's events are summed up before the shuffle, never gathered."""
    paid = tables.payments(spark, sf_dir).select("event_id", "user_id", "value")
    usual = paid.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("deviation"))
    return paid.join(usual, "user_id").select("event_id", "user_id", z.alias("z")).filter(F.abs("z") > 3.0).select("event_id", "user_id", F.round("z", 4).alias("z"))


def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.payments(spark, sf_dir).select("event_id", "event_type", "k")


def explain_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Exploded by a constant: of an exploded column Spark infers a filter, and repeats all that the column is made of in it.
    places = F.explode(F.sequence(F.lit(1), F.lit(len(profile.agent_score_columns()))))
    each = _assessed(spark, sf_dir).select("applicant_id", "factors", places.alias("place"))
    return each.select("applicant_id", F.element_at("factors", F.col("place")).alias("x")).select("applicant_id", "x.*")


def reasoning_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of three agents for each applicant: how the agent judges and why."""
    shown = _scored(spark, sf_dir).select("applicant_id", F.inline("agents")).filter(F.col("agent_name").isin(*catalog.CARDS))
    return shown.join(F.broadcast(catalog.reasons(spark)), "agent_name").select("applicant_id", "agent_name", decision.score_band(F.col("effective")).alias("judgement"), "reason")


def counterparty_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of an applicant's purchases over suppliers: the sum of squared shares."""
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_suppkey", C.cents(F.col("l_extendedprice")).alias("amount"))
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("applicant_id"))
    by = lines.join(orders, "order_id").groupBy("applicant_id", "l_suppkey").agg(C.amount(F.sum("amount")).alias("amount"))
    return by.groupBy("applicant_id").agg(F.count("*").alias("suppliers"), F.round(F.sum(F.col("amount") * F.col("amount")) / F.pow(F.sum("amount"), 2.0), 6).alias("hhi"))


def revenue_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.trend(profile.monthly(tables.ledger(spark, sf_dir))).select("applicant_id", "months", "slope")


def upi_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.daily(tables.payments(spark, sf_dir))


def upi_daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.upsert(stream.daily(stream.read_stream(spark, sf_dir)), ["day", "event_type"])


def upi_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(tables.payments(spark, sf_dir)).select("user_id", "started", "n_events", "micros")


def coaching_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tip for each agent that scores under 60 from its own end."""
    return _assessed(spark, sf_dir).select("applicant_id", F.explode("tips").alias("tip"))


def recommendation_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suggestions of the recommendation in their order, after the coach's tips took their place."""
    advised = _assessed(spark, sf_dir).select("applicant_id", decision.overwrite_suggestions(decision.recommendation(), F.col("tips")).alias("r"))
    return advised.select("applicant_id", F.posexplode("r.suggestions").alias("place", "suggestion"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """applicant_id and report, the nested report of every applicant."""
    return _assessed(spark, sf_dir).select("applicant_id", decision.report())


def _flat(reported: DataFrame, *more: str) -> DataFrame:
    """Reports (applicant_id, report) as columns of one level, with the columns `more` beside the id."""
    count = lambda c: F.size(f"report.{c}").cast("bigint")
    joined = lambda c: F.array_join(f"report.{c}", ",")
    offer = ("principal_inr", "interest_rate", "emi", "maximum_inr", "rate_high", "repayment_capacity", "risk_level")
    return reported.select(
        "applicant_id", *more, "report.company_summary.*", F.col("report.verification.status").alias("verification_status"), F.col("report.verification.confidence").alias("verification_confidence"),
        count("timeline.revenue").alias("n_months"), count("timeline.payroll").alias("n_payroll_months"), count("timeline.upi").alias("n_upi_months"),
        F.round(F.aggregate(F.map_values("report.timeline.cash_flow"), F.lit(0.0), lambda s, x: s + x), 2).alias("cash_flow"), F.round(F.aggregate(F.map_values("report.timeline.upi"), F.lit(0.0), lambda s, x: s + x), 2).alias("upi"),
        F.element_at("report.scores", "Cash Flow").alias("cash_flow_score"), "report.decision.*", "report.decision_confidence.confidence", "report.decision_confidence.confidence_level",
        *[F.col("report.decision_confidence.factors")[c].alias(c) for c in CONFIDENCE_FACTORS], *[f"report.recommendation.{c}" for c in offer], joined("recommendation.suggestions").alias("suggestions"),
        joined("risk_factors").alias("risk_factors"), count("explainability.positive_factors").alias("positive_factors"), count("explainability.negative_factors").alias("negative_factors"),
        joined("explainability.evidence_used").alias("evidence_used"), F.col("report.explainability.reason_for_recommendation").alias("reason"),
    )


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report of every applicant, flattened."""
    return _flat(reports(spark, sf_dir))


def workflow(spark: SparkSession, sf_dir: str, log: monitor.RunLog, retries: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """The reports of all applicants, written to the shared folder, and numbers of the run, made by the seven stages under a log.

    Stages hand on a dictionary. The first two count what they find in the documents and in the ledger, so that a table
    that cannot be read fails its own stage; the next four build plans; the last one computes and writes the reports, once.
    A stage that fails is tried again up to `retries` times.
    """

    def document(made: dict) -> dict:
        status = F.col("status")
        found = doc_verification(spark, sf_dir).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), *[F.coalesce(F.sum(F.when(status == x, F.col("n"))), F.lit(0)).alias(f"n_{x.lower()}") for x in ("Verified", "Warning", "Failed")])
        read = document_features(spark, sf_dir).agg(F.count_if("mentions_license").alias("n_licensed"))
        return made | {"numbers": found.first().asDict() | read.first().asDict()}

    def financial(made: dict) -> dict:
        issues = validation_issues(spark, sf_dir).agg(F.count("*").alias("n_issues")).first().asDict()
        return made | {"ledger": tables.ledger(spark, sf_dir), "numbers": made["numbers"] | issues}

    def feature(made: dict) -> dict:
        return made | {"features": profile.features(tables.applicants(spark, sf_dir), made["ledger"], tables.payments(spark, sf_dir))}

    def agents(made: dict) -> dict:
        return made | {"scored": profile.scored(made["features"])}

    def decide(made: dict) -> dict:
        return made | {"judged": decision.judge(made["scored"])}

    def recommend(made: dict) -> dict:
        return made | {"advised": decision.offer(made["judged"])}

    def reporting(made: dict) -> dict:
        seen = Observation()
        reported = made["advised"].select("applicant_id", decision.report()).observe(seen, F.count(F.lit(1)).alias("n"))
        return made | {"reports": materialize(reported, "reports"), "numbers": made["numbers"] | {"n_reports": seen.get["n"]}}

    made = monitor.run_stages(log, list(zip(catalog.STAGES, (document, financial, feature, agents, decide, recommend, reporting), strict=True)), {}, retries)
    return made["reports"], made["numbers"]


def workflow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a run of the seven stages over all applicants, flattened and without its time, and what the run counted."""
    log = monitor.RunLog()
    _, numbers = workflow(spark, sf_dir, log)
    return monitor.status(log.to_df(spark)).select("current_stage", F.size("completed_stages").alias("n_completed"), "running_stage", "failed_stage", "retry_count", "pipeline_health", *[F.lit(n).cast("bigint").alias(c) for c, n in numbers.items()])


def workflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened in a run, in order."""
    log = monitor.RunLog()
    workflow(spark, sf_dir, log)
    return log.to_df(spark).select("seq", "event", "stage", "again")


def initial_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state before anything has run."""
    return monitor.status(monitor.RunLog().to_df(spark)).select("current_stage", F.size("completed_stages").alias("n_completed"), "running_stage", "failed_stage", "retry_count", "execution_time_ms", "pipeline_health")


def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What processing returns for every applicant: status, the state of the run, what it counted, and the whole report.

    The reports are those that the run has written, so that nothing is computed twice.
    """
    log = monitor.RunLog()
    made, numbers = workflow(spark, sf_dir, log)
    state = monitor.status(log.to_df(spark)).select("current_stage", "pipeline_health").first()  # one row, whatever the log
    told = {"status": F.lit("success")} | {k: F.lit(v) for k, v in state.asDict().items()} | {k: F.lit(v).cast("bigint") for k, v in numbers.items()}
    return _flat(made.withColumns(told), *told)


_ROUND2 = "CAST(round(CAST({} AS DECIMAL(18,6)), 2) AS DOUBLE)"
_BASE = """
WITH cost AS (
  SELECT l_orderkey AS order_id, sum(CAST(round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS net, sum(CAST(round(CAST(l_extendedprice * (1 - l_discount) * l_tax AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS tax,
         count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
ledger AS (
  SELECT o_orderkey AS order_id, o_custkey AS applicant_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice AS amount, CAST(round(CAST(o_totalprice AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS revenue,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS settled, coalesce(net, 0) AS expense, coalesce(tax, 0) AS tax, coalesce(lines, 0) AS lines, coalesce(returned, 0) AS returned
  FROM orders LEFT JOIN cost ON order_id = o_orderkey),
monthly AS (SELECT applicant_id, month, sum(revenue) AS revenue, sum(expense) AS expense, sum(tax) AS tax FROM ledger GROUP BY 1, 2),
trend AS (
  SELECT applicant_id, count(*) AS months, round(avg(CAST(revenue AS DOUBLE)), 8) AS avg_month,
         CASE WHEN count(*) >= 2 THEN CAST(round(CAST(regr_slope(CAST(revenue AS DOUBLE), CAST(year(month) * 12 + month(month) AS DOUBLE)) AS DECIMAL(18,6)), 4) AS DOUBLE) END AS slope FROM monthly GROUP BY 1),
per AS (
  SELECT applicant_id, count(*) AS n_orders, count(*) FILTER (lines = 0) AS bare_orders, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(expense) AS DOUBLE) AS expense, CAST(sum(tax) AS DOUBLE) AS tax, sum(lines)::DOUBLE AS lines,
         sum(returned)::DOUBLE AS returned, sum(settled)::DOUBLE AS settled, round(stddev_samp(amount) / nullif(avg(amount), 0), 6) AS cv FROM ledger GROUP BY 1),
span AS (SELECT applicant_id, min(month) AS first_month, max(month) AS last_month, sum(CAST(revenue - expense - tax AS DOUBLE)) AS cash FROM monthly GROUP BY 1),
yearly AS (
  SELECT applicant_id, last_month, first_month, cash, sum(CAST(revenue AS DOUBLE)) FILTER (year(month) = year(last_month)) AS y0, sum(CAST(revenue AS DOUBLE)) FILTER (year(month) = year(last_month) - 1) AS y1
  FROM monthly JOIN span USING (applicant_id) GROUP BY ALL),
upi AS (SELECT user_id AS applicant_id, CAST(sum(CAST(round(CAST(value AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS DOUBLE) AS upi_total, CAST(count(*) AS DOUBLE) AS upi_count FROM events WHERE event_type = 'purchase' GROUP BY 1),
wide AS (
  SELECT c_custkey AS applicant_id, c_name AS name, c_mktsegment AS industry, CASE WHEN NOT isnan(c_acctbal) THEN c_acctbal END AS balance, coalesce(n_orders, 0) AS n_orders, coalesce(bare_orders, 0) AS bare_orders, coalesce(months, 0) AS months, coalesce(cash, 0) AS cash,
         coalesce(revenue, 0) AS revenue, coalesce(expense, 0) AS expense, coalesce(tax, 0) AS tax, coalesce(cv, 1) AS cv,
         round((coalesce(revenue, 0) - coalesce(expense, 0)) / nullif(revenue, 0), 6) AS margin, round(returned / nullif(lines, 0), 6) AS return_rate, round(settled / nullif(n_orders, 0), 6) AS settled_share,
         round(coalesce(slope / nullif(avg_month, 0), 0), 6) AS trend, coalesce(avg_month, 0) AS avg_month, round(100 * (y0 / nullif(y1, 0) - 1), 4) AS growth_yoy,
         round(months::DOUBLE / (year(last_month) * 12 + month(last_month) - year(first_month) * 12 - month(first_month) + 1), 6) AS filing_consistency, upi_total, upi_count
  FROM customer LEFT JOIN per ON per.applicant_id = c_custkey LEFT JOIN trend ON trend.applicant_id = c_custkey LEFT JOIN yearly ON yearly.applicant_id = c_custkey LEFT JOIN upi ON upi.applicant_id = c_custkey),
scores AS (
  SELECT applicant_id, industry, agent_name, CASE WHEN NOT isnan(raw) THEN round(greatest(0, least(100, raw)), 6) END AS score FROM (
    SELECT applicant_id, industry, unnest(['Financial Health', 'Cash Flow', 'Fraud Risk', 'Forecast', 'Compliance', 'Business Stability']) AS agent_name,
           unnest([50 + 50 * coalesce(margin, 0), 100 - 60 * cv, 100 * coalesce(return_rate, 0), 50 + 500 * trend, 50 + 50 * coalesce(settled_share, 0), 50 + coalesce(balance, 0) / 200]) AS raw FROM wide)),
eff AS (SELECT *, CASE WHEN agent_name = 'Fraud Risk' THEN 100 - score ELSE score END AS e FROM scores),
mean AS (SELECT applicant_id, industry, round(avg(e), 6) AS mean_score FROM eff GROUP BY 1, 2),
decided AS (SELECT *, CASE WHEN mean_score IS NULL OR isnan(mean_score) THEN NULL WHEN mean_score > 70 THEN 'Approve' WHEN mean_score > 50 THEN 'Review' ELSE 'Reject' END AS decision FROM mean),
scen AS (SELECT * FROM (VALUES ('base', 0.0::DOUBLE, 9.5::DOUBLE), ('drop', 15.0, 9.5), ('rate', 0.0, 14.0), ('both', 15.0, 14.0)) t(scenario, revenue_drop, interest_rate)),
stressed AS (SELECT *, mean_score - CASE WHEN revenue_drop > 10 THEN 15 ELSE 0 END AS s FROM decided, scen),
relabelled AS (SELECT *, CASE WHEN s > 70 THEN 'Approve' WHEN s > 50 THEN 'Review' ELSE 'Reject' END AS stressed_decision FROM stressed),
agreed AS (SELECT applicant_id, round(greatest(avg(CASE WHEN e > 50 THEN 1.0::DOUBLE ELSE 0 END), 1 - avg(CASE WHEN e > 50 THEN 1.0::DOUBLE ELSE 0 END)), 4) AS confidence FROM eff GROUP BY 1),
banded AS (
  SELECT applicant_id, confidence, CASE WHEN confidence >= 0.9 THEN 'Very High' WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_level, confidence AS agreement,
         round(1 - coalesce(bare_orders::DOUBLE / nullif(n_orders, 0), 0), 4) AS document_quality, round(least(1.0, months / 24.0::DOUBLE), 4) AS history,
         round(((margin IS NOT NULL)::INT + (return_rate IS NOT NULL)::INT + (settled_share IS NOT NULL)::INT + (growth_yoy IS NOT NULL)::INT + (filing_consistency IS NOT NULL)::INT + (upi_total IS NOT NULL)::INT) / 6.0::DOUBLE, 4) AS completeness
  FROM agreed JOIN wide USING (applicant_id)),
"""
_RUPEES = "CASE WHEN length({x}) <= 3 THEN '₹ ' || {x} ELSE '₹ ' || reverse(rtrim(regexp_replace(reverse(left({x}, length({x}) - 3)), '(..)', '\\1,', 'g'), ',')) || ',' || right({x}, 3) END"


def _offer_sql(name: str, source: str) -> str:
    """The offers that go with the decisions of a relation (key, applicant_id, decision)."""
    power = "pow(1 + interest_rate / 1200, 36)"
    return f"""
{name}_offer AS (
  SELECT key, applicant_id, decision, confidence, avg_month, CASE WHEN decision = 'Approve' THEN 9.5::DOUBLE ELSE 11.5::DOUBLE END AS interest_rate, avg_month * 6 AS wanted,
         greatest(0, coalesce((revenue - expense - tax) / nullif(months, 0), 0) * 0.5::DOUBLE) AS payment FROM {source} JOIN wide USING (applicant_id) JOIN agreed USING (applicant_id)),
{name}_borne AS (SELECT *, payment / ((interest_rate / 1200) * {power} / ({power} - 1)) AS bearable FROM {name}_offer),
{name}_sized AS (
  SELECT *, CASE WHEN decision = 'Reject' THEN 0.0::DOUBLE ELSE floor(CAST(round(CAST(least(wanted, bearable) AS DECIMAL(18,6)), 2) AS DOUBLE)) END AS principal,
         CASE WHEN decision = 'Reject' THEN 0.0::DOUBLE ELSE floor(CAST(round(CAST(bearable AS DECIMAL(18,6)), 2) AS DOUBLE)) END AS maximum_principal,
         decision <> 'Reject' AND round(CAST(bearable AS DECIMAL(18,6)), 2) < round(CAST(wanted AS DECIMAL(18,6)), 2) AS capped FROM {name}_borne),
{name}_paid AS (
  SELECT *, CAST(round(CAST(principal * (interest_rate / 1200) * {power} / ({power} - 1) AS DECIMAL(18,6)), 2) AS DOUBLE) AS emi,
         CAST(CAST(trunc(principal) AS BIGINT) AS VARCHAR) AS x, CAST(CAST(trunc(maximum_principal) AS BIGINT) AS VARCHAR) AS y FROM {name}_sized),
{name}_shared AS (SELECT *, coalesce(round(emi / nullif(avg_month, 0), 6), 0) AS payment_share FROM {name}_paid),
{name} AS (
  SELECT key, applicant_id, decision, principal, maximum_principal, interest_rate, emi, payment_share, capped, {_RUPEES.format(x='x')} AS principal_inr, {_RUPEES.format(x='y')} AS maximum_inr,
         round(interest_rate + 4 * (1 - confidence), 2) AS rate_high, CASE WHEN principal <= 0 THEN 'none' WHEN payment_share <= 0.15 THEN 'strong' WHEN payment_share <= 0.25 THEN 'fair' ELSE 'strained' END AS repayment_capacity,
         CASE WHEN decision = 'Approve' AND confidence >= 0.75 THEN 'Low' WHEN decision IN ('Approve', 'Review') THEN 'Medium' ELSE 'High' END AS risk_level FROM {name}_shared)"""


_BASE += "plain AS (SELECT 'base' AS key, applicant_id, decision FROM decided)," + _offer_sql("offered", "plain") + """,
factor AS (
  SELECT applicant_id, agent_name, CASE WHEN e - 50 >= 0 THEN 'positive' ELSE 'negative' END AS direction,
         CAST(round(CAST(coalesce((e - 50) / nullif(sum(abs(e - 50)) OVER (PARTITION BY applicant_id), 0), 0) AS DECIMAL(18,6)), 2) AS DOUBLE) AS impact FROM eff),
tips AS (
  SELECT applicant_id, tip FROM eff JOIN (VALUES ('Compliance', 'file_returns_on_time'), ('Business Stability', 'complete_registration'), ('Cash Flow', 'raise_average_balance'), ('Financial Health', 'lower_emi_to_revenue')) t(agent_name, tip) USING (agent_name) WHERE e < 60)
"""
_REPORT = """
, f AS (SELECT applicant_id, count(*) FILTER (direction = 'positive') AS positive_factors, count(*) FILTER (direction = 'negative') AS negative_factors FROM factor GROUP BY 1),
places AS (SELECT * FROM (VALUES ('Financial Health', 1), ('Cash Flow', 2), ('Fraud Risk', 3), ('Forecast', 4), ('Compliance', 5), ('Business Stability', 6)) t(agent_name, place)),
t AS (SELECT applicant_id, string_agg(tip, ',' ORDER BY place) AS suggestions FROM tips
      JOIN (VALUES ('file_returns_on_time', 1), ('complete_registration', 2), ('raise_average_balance', 3), ('lower_emi_to_revenue', 4)) t(tip, place) USING (tip) GROUP BY 1),
r AS (SELECT applicant_id, string_agg(agent_name, ',' ORDER BY place) AS risk_factors FROM eff JOIN places USING (agent_name) WHERE e <= 50 GROUP BY 1),
why AS (SELECT applicant_id, arg_min(direction || ':' || agent_name, 10 * round(-abs(impact) * 100) + place) AS reason FROM factor JOIN places USING (agent_name) GROUP BY 1),
um AS (SELECT user_id AS applicant_id, count(DISTINCT date_trunc('month', ts)) AS n_upi_months FROM events WHERE event_type = 'purchase' GROUP BY 1),
common AS (
  SELECT wide.applicant_id, 'CMP-' || wide.applicant_id AS company_id, name, wide.industry,
         CASE WHEN balance < 0 THEN 'Failed' WHEN bare_orders > 0 OR months = 0 THEN 'Warning' ELSE 'Verified' END AS verification_status, round(1 - coalesce(bare_orders::DOUBLE / nullif(n_orders, 0), 0), 4) AS verification_confidence,
         months AS n_months, 0::BIGINT AS n_payroll_months, coalesce(n_upi_months, 0) AS n_upi_months, round(cash, 2) AS cash_flow, round(coalesce(upi_total, 0), 2) AS upi, s.score AS cash_flow_score,
         confidence, confidence_level, agreement, document_quality, history, completeness, coalesce(suggestions, '') AS suggestions, coalesce(risk_factors, '') AS risk_factors, positive_factors, negative_factors,
         concat_ws(',', CASE WHEN n_orders > 0 THEN 'orders' END, CASE WHEN months > 0 THEN 'tax_filings' END, CASE WHEN upi_count > 0 THEN 'digital_payments' END, CASE WHEN return_rate IS NOT NULL THEN 'returns' END) AS evidence_used, reason
  FROM wide JOIN banded USING (applicant_id) JOIN f USING (applicant_id) JOIN why USING (applicant_id) JOIN scores s ON s.applicant_id = wide.applicant_id AND agent_name = 'Cash Flow'
  LEFT JOIN t ON t.applicant_id = wide.applicant_id LEFT JOIN r ON r.applicant_id = wide.applicant_id LEFT JOIN um ON um.applicant_id = wide.applicant_id)
"""
_OFFERED = "principal_inr, interest_rate, emi, maximum_inr, rate_high, repayment_capacity, risk_level"
_FULL = _BASE + _REPORT + f"""
, full_report AS (
  SELECT common.*, CAST(round(CAST(mean_score AS DECIMAL(18,6)), 2) AS DOUBLE) AS overall_health_score, decided.decision, {_OFFERED}
  FROM common JOIN decided USING (applicant_id) JOIN offered USING (applicant_id))
"""
_NUMBERS = """
  (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0) AS n_verified,
  (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL) AS n_warning, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE NOT (quality = 1 AND toxic = 0)) AS n_failed,
  (SELECT count(*) FROM documents WHERE contains(lower(coalesce(text, '')), 'license')) AS n_licensed,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) + (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n_issues, (SELECT count(*) FROM customer) AS n_reports"""
_FEATURES = _BASE + """
, feature AS (SELECT * FROM (
  SELECT applicant_id, 'revenue' AS feature_group, 'revenue' AS feature, CAST(revenue AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'revenue' AS feature_group, 'avg_month' AS feature, CAST(avg_month AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'profitability' AS feature_group, 'margin' AS feature, CAST(margin AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'cash_flow' AS feature_group, 'cv' AS feature, CAST(cv AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'growth' AS feature_group, 'trend' AS feature, CAST(trend AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'growth' AS feature_group, 'growth_yoy' AS feature, CAST(growth_yoy AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'gst_compliance' AS feature_group, 'tax' AS feature, CAST(tax AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'gst_compliance' AS feature_group, 'filing_consistency' AS feature, CAST(filing_consistency AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'digital_payment' AS feature_group, 'upi_total' AS feature, CAST(upi_total AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'digital_payment' AS feature_group, 'upi_count' AS feature, CAST(upi_count AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'credit_behaviour' AS feature_group, 'settled_share' AS feature, CAST(settled_share AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'business_stability' AS feature_group, 'return_rate' AS feature, CAST(return_rate AS DOUBLE) AS value FROM wide
  UNION ALL SELECT applicant_id, 'business_stability' AS feature_group, 'balance' AS feature, CAST(balance AS DOUBLE) AS value FROM wide) WHERE value IS NOT NULL)
"""
_DAILY = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(CAST(value AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2"
ORACLES = {
    "decision_summary": _BASE + f"SELECT applicant_id, {_ROUND2.format('mean_score')} AS overall_health_score, decision FROM decided",
    "monthly_timeline": _BASE + """
        SELECT applicant_id, month, CAST(revenue AS DOUBLE) AS revenue, round(CAST(revenue AS DOUBLE) / nullif(first_value(CAST(revenue AS DOUBLE)) OVER w, 0), 6) AS growth,
               CAST(revenue - lag(revenue) OVER w AS DOUBLE) AS delta FROM monthly WINDOW w AS (PARTITION BY applicant_id ORDER BY month)""",
    "cashflow_timeline": _BASE + "SELECT applicant_id, month, CAST(revenue AS DOUBLE) AS revenue, CAST(expense AS DOUBLE) AS expense, CAST(tax AS DOUBLE) AS tax, CAST(revenue - expense - tax AS DOUBLE) AS cash_flow FROM monthly",
    "series_full_outer": _BASE + """
        , r AS (SELECT month, CAST(sum(revenue) AS DOUBLE) AS revenue FROM ledger GROUP BY 1),
        u AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, CAST(sum(CAST(round(CAST(value AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS DOUBLE) AS upi FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT coalesce(r.month, u.month) AS month, revenue, upi FROM r FULL JOIN u ON r.month = u.month""",
    "features_long": _FEATURES + "SELECT * FROM feature",
    "feature_groups": _FEATURES + """
        , groups AS (SELECT unnest(['revenue', 'profitability', 'cash_flow', 'growth', 'gst_compliance', 'digital_payment', 'credit_behaviour', 'business_stability', 'payroll']) AS feature_group)
        SELECT applicant_id, feature_group, (SELECT count(*) FROM feature f WHERE f.applicant_id = wide.applicant_id AND f.feature_group = groups.feature_group) AS n FROM wide, groups""",
    "agent_results_map": _BASE + "SELECT applicant_id, agent_name, CASE WHEN agent_name IN ('Cash Flow', 'Forecast') THEN score / 2 ELSE score END AS score FROM scores",
    "gst_filings": _BASE + "SELECT applicant_id, month, CAST(expense AS DOUBLE) AS taxable, CAST(tax AS DOUBLE) AS tax FROM monthly",
    "scenario_suggestions": _BASE + """
        , s AS (SELECT applicant_id, scenario, CASE WHEN interest_rate > 12 THEN ['offer_amount', 'offer_rate', 'high_rate_strains_repayment'] ELSE ['offer_amount', 'offer_rate'] END AS list FROM relabelled)
        SELECT applicant_id, scenario, CAST(unnest(range(len(list))) AS INTEGER) AS place, unnest(list) AS suggestion FROM s""",
    "scenario_reports": _BASE + ", hit AS (SELECT scenario AS key, applicant_id, stressed_decision AS decision FROM relabelled)," + _offer_sql("stressed_offers", "hit") + _REPORT + f"""
        SELECT common.* REPLACE (concat_ws(',', nullif(suggestions, ''), CASE WHEN r.interest_rate > 12 THEN 'high_rate_strains_repayment' END) AS suggestions), scenario, r.decision AS base_decision,
               {_ROUND2.format('s')} AS overall_health_score, stressed_decision AS decision, {', '.join('o.' + c for c in _OFFERED.split(', '))}
        FROM common JOIN relabelled r ON r.applicant_id = common.applicant_id JOIN stressed_offers o ON o.applicant_id = r.applicant_id AND o.key = r.scenario""",
    "company_registry": "SELECT 'success' AS status, 'CMP-' || c_custkey AS company_id, c_name AS name FROM customer",
    "company_intake": """
        WITH y AS (SELECT o_custkey AS applicant_id, year(o_orderdate) AS year, CAST(sum(CAST(round(CAST(o_totalprice AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1, 2),
        last AS (SELECT applicant_id, arg_max(revenue, year) AS annual_revenue FROM y GROUP BY 1)
        SELECT 'CMP-' || c_custkey AS company_id, c_name AS name, c_mktsegment AS industry, annual_revenue,
               CASE WHEN c_name IS NULL OR trim(c_name) = '' OR c_mktsegment IS NULL OR annual_revenue IS NULL THEN 'missing_field' WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') THEN 'unknown_industry'
                    WHEN annual_revenue <= 0 THEN 'no_revenue' WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'no_consent' ELSE 'accepted' END AS status FROM customer LEFT JOIN last ON c_custkey = applicant_id""",
    "import_states": """
        SELECT source, CASE WHEN n_rows > 0 THEN 'done' ELSE 'idle' END AS state, n_rows FROM (
          SELECT 'gst' AS source, count(DISTINCT (o_custkey, date_trunc('month', o_orderdate))) AS n_rows FROM orders
          UNION ALL SELECT 'upi', count(*) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'banking', count(*) FROM orders)""",
    "reasoning_cards": _BASE + """
        SELECT applicant_id, agent_name, CASE WHEN e > 70 THEN 'strong' WHEN e > 50 THEN 'fair' ELSE 'weak' END AS judgement, reason
        FROM eff JOIN (VALUES ('Financial Health', 'leverage_and_growth'), ('Fraud Risk', 'no_anomalies'), ('Forecast', 'revenue_projected_to_grow')) t(agent_name, reason) USING (agent_name)""",
    "recommendation_suggestions": _BASE + """
        SELECT applicant_id, CAST(row_number() OVER (PARTITION BY applicant_id ORDER BY place) - 1 AS INTEGER) AS place, tip AS suggestion
        FROM tips JOIN (VALUES ('file_returns_on_time', 1), ('complete_registration', 2), ('raise_average_balance', 3), ('lower_emi_to_revenue', 4)) t(tip, place) USING (tip)""",
    "agent_scores_long": _BASE + "SELECT applicant_id, agent_name, score FROM scores",
    "decision_confidence": _BASE + "SELECT applicant_id, confidence, confidence_level, agreement, document_quality, history, completeness FROM banded",
    "scenario_stress": _BASE + f"SELECT applicant_id, scenario, {_ROUND2.format('s')} AS overall_health_score, stressed_decision AS decision, CAST(2 + CASE WHEN interest_rate > 12 THEN 1 ELSE 0 END AS INTEGER) AS n_suggestions FROM relabelled",
    "label_migration": _BASE + """
        SELECT scenario, decision AS from_decision, count(*) FILTER (stressed_decision = 'Approve') AS to_approve, count(*) FILTER (stressed_decision = 'Review') AS to_review,
               count(*) FILTER (stressed_decision = 'Reject') AS to_reject FROM relabelled GROUP BY 1, 2""",
    "loan_offer": _BASE + "SELECT applicant_id, decision, principal, interest_rate, emi, principal_inr, capped, payment_share, maximum_principal, rate_high, repayment_capacity, risk_level FROM offered",
    "portfolio_rollup": _BASE + """
        SELECT industry, decision, CAST(grouping(industry) AS BIGINT) AS all_industries, CAST(grouping(decision) AS BIGINT) AS all_decisions, count(*) AS n, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue
        FROM decided JOIN wide USING (applicant_id, industry) GROUP BY ROLLUP (industry, decision)""",
    "dashboard_kpis": _BASE + """
        SELECT count(*) AS applications, round(avg(CASE WHEN decision = 'Approve' THEN 1.0::DOUBLE ELSE 0 END), 6) AS approval_rate,
               coalesce(CAST(sum(CAST(revenue AS DECIMAL(18,2))) FILTER (coalesce(return_rate, 0) > 0.5) AS DOUBLE), 0) AS flagged_revenue FROM decided JOIN wide USING (applicant_id)""",
    "top_risk": _BASE + f"""
        SELECT industry, CAST(rank AS INTEGER) AS rank, applicant_id, {_ROUND2.format('mean_score')} AS overall_health_score
        FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY mean_score, applicant_id) AS rank FROM decided) WHERE rank <= 10""",
    "doc_verification": "SELECT source, CASE WHEN quality IS NULL THEN 'Warning' WHEN quality = 1 AND toxic = 0 THEN 'Verified' ELSE 'Failed' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "document_features": "SELECT doc_id, length(coalesce(text, '')) AS length, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS line_breaks, contains(lower(coalesce(text, '')), 'license') AS mentions_license FROM documents",
    "validation_issues": "SELECT 'order_without_lines' AS issue, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'negative_balance', c_custkey FROM customer WHERE c_acctbal < 0",
    "payment_anomaly": "SELECT event_id, user_id, round(z, 4) AS z FROM (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM events WINDOW w AS (PARTITION BY user_id)) WHERE abs(z) > 3",
    "props_extract": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "explain_factors": _BASE + "SELECT * FROM factor",
    "counterparty_hhi": """
        WITH s AS (SELECT o_custkey AS applicant_id, l_suppkey, CAST(sum(CAST(round(CAST(l_extendedprice AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
        SELECT applicant_id, count(*) AS suppliers, round(sum(amount * amount) / pow(sum(amount), 2), 6) AS hhi FROM s GROUP BY 1""",
    "revenue_trend": _BASE + "SELECT applicant_id, months, slope FROM trend",
    "upi_daily_windows": _DAILY,
    "upi_daily_stream": _DAILY,
    "upi_sessions": """
        WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
        SELECT user_id, min(ts) AS started, count(*) AS n_events, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM s GROUP BY user_id, session""",
    "coaching_rules": _BASE + "SELECT * FROM tips",
    "full_report": _FULL + "SELECT * FROM full_report",
    "workflow_status": "SELECT 'Completed' AS current_stage, 7 AS n_completed, CAST(NULL AS VARCHAR) AS running_stage, CAST(NULL AS VARCHAR) AS failed_stage, 0 AS retry_count, 'Healthy' AS pipeline_health," + _NUMBERS,
    "workflow_events": """
        SELECT CAST(seq AS BIGINT) AS seq, event, stage, false AS again FROM (VALUES
          (0, 'begin', NULL), (1, 'enter', 'Document Pipeline'), (2, 'leave', 'Document Pipeline'), (3, 'enter', 'Financial Pipeline'), (4, 'leave', 'Financial Pipeline'), (5, 'enter', 'Feature Pipeline'),
          (6, 'leave', 'Feature Pipeline'), (7, 'enter', 'AI Pipeline'), (8, 'leave', 'AI Pipeline'), (9, 'enter', 'Decision Pipeline'), (10, 'leave', 'Decision Pipeline'), (11, 'enter', 'Recommendation Pipeline'),
          (12, 'leave', 'Recommendation Pipeline'), (13, 'enter', 'Reporting Pipeline'), (14, 'leave', 'Reporting Pipeline'), (15, 'end', NULL)) t(seq, event, stage)""",
    "initial_status": "SELECT 'Initialized' AS current_stage, 0 AS n_completed, CAST(NULL AS VARCHAR) AS running_stage, CAST(NULL AS VARCHAR) AS failed_stage, 0 AS retry_count, 0.0::DOUBLE AS execution_time_ms, 'Healthy' AS pipeline_health",
    "process_documents": _FULL + f"SELECT *, 'success' AS status, 'Completed' AS current_stage, 'Healthy' AS pipeline_health, {_NUMBERS} FROM full_report",
}
QUERIES = {name: globals()[name] for name in ORACLES}
