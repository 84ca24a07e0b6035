"""Agent scores to decisions, offers and explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.columns import drop_penalty, effective_score, emi, format_inr, is_high_rate, label, round2, with_rate_warning
from .catalog import COACHING, OFFER_TEXTS

#: Fixed terms of an offer: months of revenue lent, months to pay, the yearly rates of an approval and a review, and the
#: share of the monthly cash flow that a payment may take.
LENT_MONTHS, TENURE, RATES, PAYMENT_SHARE = 6.0, 36.0, (9.5, 11.5), 0.5
#: How far the rate may end above its begin at no confidence, and the parts of a month's revenue that a payment is borne at.
RATE_SPREAD, STRONG_SHARE, FAIR_SHARE = 4.0, 0.15, 0.25
#: Months that make a whole history, and the columns that confidence asks for.
HISTORY_MONTHS, KNOWN = 24.0, ("margin", "return_rate", "settled_share", "growth_yoy", "filing_consistency", "upi_total")
#: Scenarios are a constant of the plan, so there may be this many at most.
MOST_SCENARIOS = 10_000


def decide(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean_score, decision of long rows (agent_name, score): the mean over rows, fraud risk from the other end."""
    mean = F.round(F.avg(effective_score(F.col("agent_name"), F.col("score"))), 6)
    return scores.groupBy(*keys).agg(mean.alias("mean_score")).withColumn("decision", label(F.col("mean_score")))


def collect_last(rows: DataFrame, keys: list[str], order: str, value: str = "score") -> DataFrame:
    """keys and results, a map of agent_name to value; of rows of one name the last by `order` counts, of equals the largest value."""
    last = rows.groupBy(*keys, "agent_name").agg(F.max(F.struct(order, value))[value].alias("x"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent_name", "x")))).alias("results"))


def with_each(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every row with every scenario's columns beside its own.

    The scenarios become a constant array of the plan that each row is exploded by, so that there is no join. More than
    MOST_SCENARIOS are an error; none leave no rows.
    """
    given = scenarios.select(F.to_json(F.struct(*[f"`{c}`" for c in scenarios.columns]))).limit(MOST_SCENARIOS + 1).collect()
    if len(given) > MOST_SCENARIOS:
        raise ValueError(f"more than {MOST_SCENARIOS} scenarios")
    return rows.select("*", F.inline(F.from_json(F.lit(f"[{','.join(x[0] for x in given)}]"), ArrayType(scenarios.schema))))


def stress(decisions: DataFrame, scenarios: DataFrame, suggestions: Column | None = None) -> DataFrame:
    """decisions under each scenario (revenue_drop and interest_rate), with the penalty and the suggestions with the added warning; see with_each."""
    score = F.col("mean_score") - drop_penalty(F.col("revenue_drop"))
    base = F.array(*map(F.lit, OFFER_TEXTS)) if suggestions is None else suggestions
    advice = with_rate_warning(base, F.col("interest_rate"))
    return with_each(decisions, scenarios).withColumns(
        {"overall_health_score": round2(score), "stressed_decision": label(score), "suggestions": advice, "n_suggestions": F.size(advice), "warned": is_high_rate(F.col("interest_rate"))}
    )


def confidence_band(confidence: Column) -> Column:
    """Low, Medium, High or Very High."""
    return F.when(confidence >= 0.9, "Very High").when(confidence >= 0.75, "High").when(confidence >= 0.5, "Medium").otherwise("Low")


def score_band(effective: Column) -> Column:
    """A reason's code: how an agent judges from its own end."""
    return F.when(effective > 70.0, "strong").when(effective > 50.0, "fair").otherwise("weak")


def offered(principal: Column, decision: Column) -> dict[str, Column]:
    """The columns of an offer of a principal: dearer for a review."""
    rate = F.when(decision == "Approve", RATES[0]).otherwise(RATES[1])
    return {"principal": principal, "interest_rate": rate, "emi": round2(emi(principal, rate, F.lit(TENURE))), "principal_inr": format_inr(principal)}


def assess(scored: DataFrame) -> DataFrame:
    """scored (wide rows with `agents`) with decision, confidence, offer, factors and tips, all on the applicant's row."""
    return offer(judge(scored))


def judge(scored: DataFrame) -> DataFrame:
    """scored with mean_score, decision, confidence and its factors, the agents' impacts, tips, evidence and reason.

    The confidence is the share of agents on one side of 50. Its factors are that share, the share of orders that have
    lines, how much of HISTORY_MONTHS there is, and the share of KNOWN columns that have a value. The reason is the agent of
    the greatest impact, of equals the first, with the way it pulls.
    """
    rows = scored.select("*", F.transform("agents", lambda x: x["effective"]).alias("e"))
    one = [F.element_at("e", i) for i in range(1, 7)]
    total = sum(one[1:], one[0])
    sided = sum((F.when(x > 50.0, 1.0).otherwise(0.0) for x in one[1:]), F.when(one[0] > 50.0, 1.0).otherwise(0.0)) / 6.0
    apart = sum((F.abs(x - 50.0) for x in one[1:]), F.abs(one[0] - 50.0))
    held = rows.select("*", F.round(total / 6.0, 6).alias("mean_score"), F.round(F.greatest(sided, 1.0 - sided), 4).alias("confidence"), apart.alias("apart")).drop("e")
    decision = label(F.col("mean_score"))
    impacts = F.transform("agents", lambda x: F.struct(
        x["agent_name"].alias("agent_name"), F.when(x["effective"] >= 50.0, "positive").otherwise("negative").alias("direction"),
        round2(F.coalesce(F.try_divide(x["effective"] - 50.0, F.col("apart")), F.lit(0.0))).alias("impact"),
    ))
    weak = F.transform(F.filter("agents", lambda x: x["effective"] < 60.0), lambda x: x["agent_name"])
    tips = F.filter(F.array(*[F.when(F.array_contains(weak, agent), tip) for agent, tip in COACHING]), lambda x: x.isNotNull())
    told = F.filter(F.array(F.when(F.col("n_orders") > 0, "orders"), F.when(F.col("months") > 0, "tax_filings"), F.when(F.col("upi_count") > 0, "digital_payments"), F.when(F.col("return_rate").isNotNull(), "returns")), lambda x: x.isNotNull())
    parts = {
        "agreement": F.col("confidence"), "document_quality": F.round(1.0 - F.coalesce(F.try_divide(F.col("bare_orders"), F.col("n_orders")), F.lit(0.0)), 4),
        "history": F.round(F.least(F.lit(1.0), F.col("months") / HISTORY_MONTHS), 4), "completeness": F.round(sum((F.col(c).isNotNull().cast("int") for c in KNOWN[1:]), F.col(KNOWN[0]).isNotNull().cast("int")) / float(len(KNOWN)), 4),
    }
    made = held.select("*", decision.alias("decision"), confidence_band(F.col("confidence")).alias("confidence_level"), impacts.alias("factors"), tips.alias("tips"), told.alias("evidence"), F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]).alias("confidence_factors"))
    first = F.element_at(F.array_sort(F.transform("factors", lambda x, i: F.struct((-F.abs(x["impact"])).alias("a"), i.alias("i"), F.concat(x["direction"], F.lit(":"), x["agent_name"]).alias("code")))), 1)
    return made.withColumn("reason", first["code"]).drop("apart")


def offer(judged: DataFrame) -> DataFrame:
    """judged rows with the offer that goes with their decision, score and confidence.

    The principal is six average months, less where its payment would take over half of the average monthly cash flow,
    which bounds the maximum; a reject has neither. The rate ends at rate_high, the further above the lower the
    confidence. payment_share is the payment's part of an average month's revenue, and repayment_capacity its band.
    """
    decision = F.col("decision")
    per_rupee = emi(F.lit(1.0), F.when(decision == "Approve", RATES[0]).otherwise(RATES[1]), F.lit(TENURE))
    cash = F.coalesce(F.try_divide(F.col("revenue") - F.col("expense") - F.col("tax"), F.col("months").cast("double")), F.lit(0.0))
    wanted, bearable = F.col("avg_month") * LENT_MONTHS, F.greatest(F.lit(0.0), cash * PAYMENT_SHARE) / per_rupee
    most = F.when(decision == "Reject", 0.0).otherwise(F.floor(round2(bearable)).cast("double"))
    principal = F.when(decision == "Reject", 0.0).otherwise(F.floor(round2(F.least(wanted, bearable))).cast("double"))
    capped = (decision != "Reject") & (round2(bearable) < round2(wanted))
    step = judged.select("*", principal.alias("principal"), most.alias("maximum_principal"), capped.alias("capped"))
    step = step.withColumns({k: v for k, v in offered(F.col("principal"), decision).items() if k != "principal"})
    step = step.withColumn("payment_share", F.coalesce(F.round(F.try_divide(F.col("emi"), F.col("avg_month")), 6), F.lit(0.0)))
    share = F.col("payment_share")
    capacity = F.when(F.col("principal") <= 0.0, "none").when(share <= STRONG_SHARE, "strong").when(share <= FAIR_SHARE, "fair").otherwise("strained")
    risk = F.when((decision == "Approve") & (F.col("confidence") >= 0.75), "Low").when(decision.isin("Approve", "Review"), "Medium").otherwise("High")
    return step.withColumns({"maximum_inr": format_inr(F.col("maximum_principal")), "rate_high": F.round(F.col("interest_rate") + RATE_SPREAD * (1.0 - F.col("confidence")), 2), "repayment_capacity": capacity, "risk_level": risk})


def restress(judged: DataFrame, scenarios: DataFrame) -> DataFrame:
    """judged rows under each scenario: the score with the penalty, the decision and the offer that go with it, tips with the warning; the unstressed decision is base_decision."""
    each = with_each(judged.withColumn("base_decision", F.col("decision")), scenarios)
    score = F.col("mean_score") - drop_penalty(F.col("revenue_drop"))
    hit = each.withColumns({"mean_score": score, "tips": with_rate_warning(F.col("tips"), F.col("interest_rate"))}).withColumn("decision", label(F.col("mean_score")))
    return offer(hit.drop("interest_rate"))


def recommendation() -> Column:
    """The struct of an offer, with the texts that go with a decision as suggestions."""
    texts = F.when(F.col("decision") == "Reject", F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, OFFER_TEXTS)))
    return F.struct("principal", "principal_inr", "maximum_principal", "maximum_inr", "interest_rate", "rate_high", "repayment_capacity", "risk_level", F.lit(int(TENURE)).alias("tenure_months"), "emi", "payment_share", "capped", texts.alias("suggestions"))


def overwrite_suggestions(recommendation: Column, tips: Column) -> Column:
    """A recommendation whose suggestions are the coach's tips and nothing else."""
    return recommendation.withField("suggestions", tips)


def report() -> Column:
    """The nested report of an assessed row."""
    series = {
        "revenue": lambda x: x["revenue"], "expense": lambda x: x["expense"], "cash_flow": lambda x: x["revenue"] - x["expense"] - x["tax"], "gst": lambda x: x["tax"],
        "business_growth": lambda x: F.round(F.try_divide(x["revenue"], F.element_at("history", 1)["revenue"]), 6),
    }
    nothing = F.map_from_entries(F.array().cast("array<struct<key:date,value:double>>"))

    def by_month(value: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.map_from_entries(F.transform("history", lambda x: F.struct(x["month"].alias("key"), value(x).alias("value")))), nothing)

    timeline = [by_month(value).alias(c) for c, value in series.items()]
    upi = F.coalesce(F.map_from_entries(F.transform("upi_history", lambda x: F.struct(x["month"].alias("key"), x["paid"].alias("value")))), nothing)
    errors = F.filter(F.array(F.when(F.col("balance") < 0, "negative_balance")), lambda x: x.isNotNull())
    warnings = F.filter(F.array(F.when(F.col("bare_orders") > 0, "orders_without_lines"), F.when(F.col("months") == 0, "no_orders")), lambda x: x.isNotNull())
    state = F.when(F.size(errors) > 0, "Failed").when(F.size(warnings) > 0, "Warning").otherwise("Verified")
    sound = F.round(1.0 - F.coalesce(F.try_divide(F.col("bare_orders"), F.col("n_orders")), F.lit(0.0)), 4)
    split = lambda way: F.transform(F.filter("factors", lambda x: x["direction"] == way), lambda x: x["agent_name"])
    return F.struct(
        F.struct(F.concat(F.lit("CMP-"), F.col("applicant_id")).alias("company_id"), "name", "industry").alias("company_summary"),
        F.struct(state.alias("status"), sound.alias("confidence"), errors.alias("errors"), warnings.alias("warnings")).alias("verification"),
        F.struct(*timeline, upi.alias("upi"), nothing.alias("payroll")).alias("timeline"),
        F.map_from_entries(F.transform("agents", lambda x: F.struct(x["agent_name"], x["score"]))).alias("scores"),
        F.struct(round2(F.col("mean_score")).alias("overall_health_score"), "decision").alias("decision"),
        F.struct("confidence", "confidence_level", F.col("confidence_factors").alias("factors")).alias("decision_confidence"),
        overwrite_suggestions(recommendation(), F.col("tips")).alias("recommendation"),
        F.filter(F.transform("agents", lambda x: F.when(x["effective"] <= 50.0, x["agent_name"])), lambda x: x.isNotNull()).alias("risk_factors"),
        F.struct(split("positive").alias("positive_factors"), split("negative").alias("negative_factors"), F.transform("factors", lambda x: x["impact"]).alias("impacts"), F.col("evidence").alias("evidence_used"), "confidence_level", F.col("reason").alias("reason_for_recommendation")).alias("explainability"),
    ).alias("report")
