"""The driver's tables and the lending concepts they stand for.

A customer is an applicant, an order is revenue, its lines' net price is expense and their tax is sales tax; purchases
in the event stream are digital payments. These are stand-ins: nothing in the tables is lending data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import amount, cents, known


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("applicant_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), known(F.col("c_acctbal")).alias("balance"))


def order_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order that has lines: net, tax (cents), lines and returned lines."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.sum(cents(net)).alias("net"), F.sum(cents(net * F.col("l_tax"))).alias("tax"),
        F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: applicant_id, month, amount, revenue, expense, tax (cents), lines, returned, settled."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("applicant_id"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), F.col("o_totalprice").alias("amount"),
        cents(F.col("o_totalprice")).alias("revenue"), (F.col("o_orderstatus") == "F").cast("int").alias("settled"),
    )
    return orders.join(order_costs(spark, sf_dir), "order_id", "left").select(
        "order_id", "applicant_id", "month", "amount", "revenue", "settled", F.coalesce("net", F.lit(0)).alias("expense"), F.coalesce("tax", F.lit(0)).alias("tax"),
        F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("returned", F.lit(0)).alias("returned"),
    )


def credit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, applicant_id, opened and closed: an order is credit from its date to the day its last line is shipped."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("applicant_id"), F.col("o_orderdate").cast("date").alias("opened"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_shipdate").cast("date").alias("closed"))
    return orders.join(shipped, "order_id")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with a typed time in UTC and the number in its JSON."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", cents(F.col("value")).alias("paid"), F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


def tax_filings(ledger: DataFrame) -> DataFrame:
    """applicant_id, month, taxable and tax of every month with orders."""
    return ledger.groupBy("applicant_id", "month").agg(amount(F.sum("expense")).alias("taxable"), amount(F.sum("tax")).alias("tax"))


def company_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company forms: name, industry, annual_revenue (that of the last year with orders) and consent, which a balance that is not negative stands for."""
    ordered = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("applicant_id"), F.year("o_orderdate").alias("year")).agg(F.sum(cents(F.col("o_totalprice"))).alias("revenue"))
    last = ordered.groupBy("applicant_id").agg(amount(F.max_by("revenue", "year")).alias("annual_revenue"))
    return applicants(spark, sf_dir).join(last, "applicant_id", "left").select("applicant_id", "name", "industry", "annual_revenue", (F.col("balance") >= 0).alias("consent"))


def intake(forms: DataFrame, industries: tuple[str, ...]) -> DataFrame:
    """forms with company_id, and status: accepted, or the first thing that is wrong; nulls are missing fields."""
    missing = F.col("name").isNull() | (F.trim("name") == "") | F.col("industry").isNull() | known(F.col("annual_revenue")).isNull()
    status = F.when(missing, "missing_field").when(~F.col("industry").isin(*industries), "unknown_industry").when(F.col("annual_revenue") <= 0, "no_revenue").when(~F.coalesce("consent", F.lit(False)), "no_consent").otherwise("accepted")
    return forms.select("applicant_id", F.concat(F.lit("CMP-"), F.col("applicant_id")).alias("company_id"), "name", "industry", "annual_revenue", status.alias("status"))
