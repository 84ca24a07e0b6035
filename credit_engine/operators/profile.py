"""Timelines, features and agent scores of applicants, from the ledger; one row for each applicant wherever that can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import amount, clamp, effective_score


def monthly(ledger: DataFrame) -> DataFrame:
    """applicant_id, month and the month's revenue, expense, tax in cents."""
    return ledger.groupBy("applicant_id", "month").agg(*[F.sum(c).alias(c) for c in ("revenue", "expense", "tax")])


def growth(monthly: DataFrame) -> DataFrame:
    """monthly revenue with its ratio to the applicant's first month and the change from the one before."""
    order = W.partitionBy("applicant_id").orderBy("month")
    revenue = amount(F.col("revenue"))
    return monthly.select(
        "applicant_id", "month", revenue.alias("revenue"),
        F.round(F.try_divide(revenue, F.first(revenue).over(order)), 6).alias("growth"),
        amount(F.col("revenue") - F.lag("revenue").over(order)).alias("delta"),
    )


def _number(month: Column) -> Column:
    """Months since the year 0."""
    return F.year(month) * 12 + F.month(month)


def trend(monthly: DataFrame) -> DataFrame:
    """applicant_id, months, avg_month and slope (of revenue over the month's number; null for a single month)."""
    revenue = amount(F.col("revenue"))
    grouped = monthly.groupBy("applicant_id").agg(F.count("*").alias("months"), F.round(F.avg(revenue), 8).alias("avg_month"), F.regr_slope(revenue, _number(F.col("month")).cast("double")).alias("slope"))
    return grouped.withColumn("slope", F.when(F.col("months") >= 2, F.round(F.col("slope").cast("decimal(18,6)"), 4).cast("double")))


def _spread(n: Column, total: Column, squares: Column) -> Column:
    """The sample deviation over the mean, from a count, a sum and a sum of squares; null for fewer than two values."""
    deviation = F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1))
    return F.when(n > 1, F.round(F.try_divide(deviation, total / n), 6))


def features(applicants: DataFrame, ledger: DataFrame, payments: DataFrame) -> DataFrame:
    """One row for each applicant; those without orders have zero revenue and null ratios.

    Orders are summed by month, and months by applicant: moments and slope come from the months, so that the ledger is
    read and shuffled once. `history` holds the months in order, upi_history those of digital payments; it is as long as the business is old, not as it is large.
    Spark leaves out the sums that a query does not use.
    """
    months = ledger.groupBy("applicant_id", "month").agg(
        *[F.sum(c).alias(c) for c in ("revenue", "expense", "tax", "lines", "returned", "settled", "amount")],
        F.count("*").alias("n_orders"), F.count_if(F.col("lines") == 0).alias("bare_orders"), F.sum(F.col("amount") * F.col("amount")).alias("squares"),
    )
    revenue = amount(F.col("revenue"))
    per = months.groupBy("applicant_id").agg(
        *[F.sum(c).alias(c) for c in ("n_orders", "bare_orders", "lines", "returned", "settled", "amount", "squares")], *[amount(F.sum(c)).alias(c) for c in ("revenue", "expense", "tax")],
        F.count("*").alias("months"), F.round(F.avg(revenue), 8).alias("avg_month"), F.regr_slope(revenue, _number(F.col("month")).cast("double")).alias("slope"),
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.array_sort(F.collect_list(F.struct("month", *[amount(F.col(c)).alias(c) for c in ("revenue", "expense", "tax")]))).alias("history"),
    )
    by_month = payments.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("applicant_id"), F.trunc(F.col("ts").cast("date"), "month").alias("month")).agg(F.sum("paid").alias("paid"), F.count("*").alias("n"))
    paid = by_month.groupBy("applicant_id").agg(
        amount(F.sum("paid")).alias("upi_total"), F.sum("n").alias("upi_count"), F.array_sort(F.collect_list(F.struct("month", amount(F.col("paid")).alias("paid")))).alias("upi_history")
    )
    joined = applicants.join(per, "applicant_id", "left").join(paid, "applicant_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    slope = F.when(F.col("months") >= 2, F.round(F.col("slope").cast("decimal(18,6)"), 4).cast("double"))
    year = lambda back: F.aggregate("history", F.lit(0.0), lambda s, x: s + F.when(F.year(x["month"]) == F.year("last_month") - back, x["revenue"]).otherwise(0.0))
    return joined.select(
        "applicant_id", "name", "industry", "balance", count("n_orders").alias("n_orders"), count("bare_orders").alias("bare_orders"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("expense", F.lit(0.0)).alias("expense"), F.coalesce("tax", F.lit(0.0)).alias("tax"), F.coalesce(_spread(F.col("n_orders"), F.col("amount"), F.col("squares")), F.lit(1.0)).alias("cv"),
        F.round(F.try_divide(F.col("revenue") - F.col("expense"), F.col("revenue")), 6).alias("margin"),
        F.round(F.try_divide(count("returned"), count("lines")), 6).alias("return_rate"), F.round(F.try_divide(count("settled"), count("n_orders")), 6).alias("settled_share"),
        F.round(F.coalesce(F.try_divide(slope, F.col("avg_month")), F.lit(0.0)), 6).alias("trend"), F.coalesce("avg_month", F.lit(0.0)).alias("avg_month"),
        F.coalesce("months", F.lit(0)).alias("months"), "first_month", "last_month", "history",
        F.round(100.0 * (F.try_divide(year(0), year(1)) - 1.0), 4).alias("growth_yoy"),
        F.round(F.col("months") / (_number(F.col("last_month")) - _number(F.col("first_month")) + 1), 6).alias("filing_consistency"),
        F.col("upi_total"), F.col("upi_count").cast("double").alias("upi_count"), "upi_history",
    )


#: Feature groups: column, group. Nothing in the tables is a payroll, so that group has no features.
GROUPS = (
    ("revenue", "revenue"), ("avg_month", "revenue"), ("margin", "profitability"), ("cv", "cash_flow"), ("trend", "growth"), ("growth_yoy", "growth"), ("tax", "gst_compliance"),
    ("filing_consistency", "gst_compliance"), ("upi_total", "digital_payment"), ("upi_count", "digital_payment"), ("settled_share", "credit_behaviour"), ("return_rate", "business_stability"), ("balance", "business_stability"),
)
EMPTY_GROUPS = ("payroll",)


def features_long(wide: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c, g in GROUPS])
    return wide.select("applicant_id", F.inline(rows)).filter("value IS NOT NULL")


def feature_maps() -> Column:
    """A struct of one map for each feature group, with the features that are known; empty for groups without any."""

    def of(group: str) -> Column:
        rows = [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c, g in GROUPS if g == group]
        known = F.filter(F.array(*rows), lambda x: x["value"].isNotNull()) if rows else F.array().cast("array<struct<key:string,value:double>>")
        return F.map_from_entries(known).alias(group)

    return F.struct(*[of(g) for g in dict.fromkeys([*[g for _, g in GROUPS], *EMPTY_GROUPS])])


def agent_score_columns() -> dict[str, Column]:
    """Each agent's score of a wide row: stand-ins on a scale of 0 to 100."""
    by = {
        "Financial Health": 50.0 + 50.0 * F.coalesce("margin", F.lit(0.0)),
        "Cash Flow": 100.0 - 60.0 * F.col("cv"),
        "Fraud Risk": 100.0 * F.coalesce("return_rate", F.lit(0.0)),
        "Forecast": 50.0 + 500.0 * F.col("trend"),
        "Compliance": 50.0 + 50.0 * F.coalesce("settled_share", F.lit(0.0)),
        "Business Stability": 50.0 + F.coalesce("balance", F.lit(0.0)) / 200.0,
    }
    return {agent: F.round(clamp(x), 6) for agent, x in by.items()}


def scored(wide: DataFrame) -> DataFrame:
    """wide with `agents`, an array of (agent_name, score, effective): six entries that stay on the applicant's row."""
    agents = [F.struct(F.lit(n).alias("agent_name"), x.alias("score"), effective_score(F.lit(n), x).alias("effective")) for n, x in agent_score_columns().items()]
    return wide.withColumn("agents", F.array(*agents))


def agent_scores(wide: DataFrame) -> DataFrame:
    """applicant_id, industry, agent_name and score, one row for each of six agents."""
    return scored(wide).select("applicant_id", "industry", F.inline("agents")).drop("effective")
