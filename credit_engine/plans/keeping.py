"""Queries on what is kept and what came before: tables in versions, sketches of months, chains of orders. Their SQL is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lineage, profile, sketches
from ..sinks.versioned import VersionedTable
from ..sources import tables
from ..storage import materialize, new_path
from .lending import _BASE

QUANTILES = {"p50": 0.5, "p90": 0.9}


def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of all applicants from a versioned table: first of settled orders only, then corrected by all orders, a batch taken twice."""
    months = lambda ledger: profile.monthly(ledger).select("applicant_id", F.year("month").alias("year"), "month", *[C.amount(F.col(c)).alias(c) for c in ("revenue", "expense", "tax")])
    ledger = tables.ledger(spark, sf_dir)
    kept = VersionedTable(spark, new_path(spark, "ledger_versions"), ["applicant_id", "month"], "year")
    settled = kept.upsert(months(ledger.filter("settled = 1")), "settled")
    for _ in range(2):
        corrected = kept.upsert(months(ledger), "all")
    before = kept.read(settled).select("applicant_id", "month", F.col("revenue").alias("settled_revenue"))
    return kept.read(corrected).join(before, ["applicant_id", "month"], "left")


def sketched_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of shipped lines from sketches of months: how many, and whether distinct orders and prices' quantiles are within the error bounds of the exact ones."""
    lines = tables.table(spark, sf_dir, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), "l_orderkey", "l_extendedprice")
    stored = materialize(sketches.sketched(lines, ["month"], "l_orderkey", "l_extendedprice"), "sketches")
    quarter = {"quarter": F.trunc("month", "quarter")}
    answers = sketches.told(sketches.merged(stored, quarter), QUANTILES)
    exact = lines.groupBy(*[x.alias(c) for c, x in quarter.items()]).agg(F.count_distinct("l_orderkey").alias("orders"))
    # A quarter has one answer, so the answers are a few rows; ranks of the quantiles are counted, not sorted for.
    below = lines.join(answers.select(F.col("quarter"), *QUANTILES), F.trunc("month", "quarter") == F.col("quarter")).groupBy("quarter").agg(*[F.avg((F.col("l_extendedprice") <= F.col(c)).cast("double")).alias(f"rank_{c}") for c in QUANTILES])
    joined = answers.join(exact, "quarter").join(below, "quarter")
    near = [(F.abs(F.col(f"rank_{c}") - q) <= sketches.RANK_ERROR + 1.0 / F.col("n")).alias(f"{c}_near") for c, q in QUANTILES.items()]
    return joined.select("quarter", "n", "orders", (F.abs(F.col("distinct") - F.col("orders")) <= sketches.DISTINCT_ERROR * F.col("orders")).alias("orders_near"), *near)


def order_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders led to which: an order leads to the applicant's next one from a supplier that both buy from."""
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_suppkey").distinct()
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderdate")
    following = F.lead("order_id").over(W.partitionBy("o_custkey", "l_suppkey").orderBy("o_orderdate", "order_id"))
    edges = lines.join(orders, "order_id").select(F.col("order_id").alias("src"), following.alias("dst")).filter("dst IS NOT NULL")
    return lineage.lineage(edges).select("ancestor", F.col("node").alias("descendant"), "steps", "longest", "cyclic")


ORACLES = {
    "order_lineage": """
        WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
        e AS (SELECT DISTINCT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey, l_suppkey ORDER BY o_orderdate, o_orderkey) AS dst FROM l JOIN orders ON l_orderkey = o_orderkey) WHERE dst IS NOT NULL),
        r AS (SELECT src, dst, 1 AS n FROM e UNION SELECT r.src, e.dst, n + 1 FROM r JOIN e ON r.dst = e.src)
        SELECT src AS ancestor, dst AS descendant, CAST(min(n) AS INTEGER) AS steps, CAST(max(n) AS INTEGER) AS longest, false AS cyclic FROM r GROUP BY 1, 2""",
    "ledger_versions": _BASE + """
        , s AS (SELECT applicant_id, month, CAST(sum(revenue) AS DOUBLE) AS settled_revenue FROM ledger WHERE settled = 1 GROUP BY 1, 2)
        SELECT m.applicant_id, CAST(year(m.month) AS INTEGER) AS year, m.month, CAST(revenue AS DOUBLE) AS revenue, CAST(expense AS DOUBLE) AS expense, CAST(tax AS DOUBLE) AS tax, settled_revenue
        FROM monthly m LEFT JOIN s ON s.applicant_id = m.applicant_id AND s.month = m.month""",
    "sketched_quarters": """
        SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, count(*) AS n, count(DISTINCT l_orderkey) AS orders, true AS orders_near, true AS p50_near, true AS p90_near FROM lineitem GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
