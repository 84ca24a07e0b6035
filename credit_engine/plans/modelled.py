"""Queries of the models behind the agents: what decided, who is apart from the others, which orders will be late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..models import attribution, boosting, isolation, ranking
from ..operators import profile
from ..sources import tables
from ..storage import materialize
from .lending import _BASE, _assessed, _scored, _wide

#: What the fraud agent's forest looks at.
FRAUD_FEATURES = ["margin", "cv", "return_rate", "settled_share", "trend", "avg_month", "filing_consistency", "upi_total"]
#: What is known of an order when it is placed; an order is late if its last line leaves after this many days.
ORDER_FEATURES = ["lines", "amount", "quantity", "discount", "priority", "month", "balance", "mean_score"]
LATE_DAYS, TRAINED_SHARE = 90, 0.8
#: What part of a risk is handed on, and how often; the query's rounds are fixed, so that its SQL has as many.
CONTAGION, CONTAGION_ROUNDS = 0.6, 8


def decision_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Shapley value of each agent for each applicant's label: 0 for a reject, 1 for a review, 2 for an approval."""
    names = [n for n, _ in profile.agent_score_columns().items()]
    players = [F.element_at("agents", i + 1)["effective"] for i in range(len(names))]
    worths = _scored(spark, sf_dir).select("applicant_id", attribution.coalitions(players, attribution.label_worth).alias("worths"))
    return worths.select("applicant_id", F.inline(attribution.attributed(names, F.col("worths"))))


def fraud_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each applicant is apart from the others, 0..1, by a forest over eight features."""
    wide = _wide(spark, sf_dir)
    forest = isolation.fit(wide, FRAUD_FEATURES, "applicant_id")
    return wide.select("applicant_id", F.round(forest.score(), 6).alias("apart"))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, opened, ORDER_FEATURES and `late` of every order that has lines."""
    lines = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.max("l_shipdate").cast("date").alias("closed")
    )
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("applicant_id"), F.col("o_orderdate").cast("date").alias("opened"), F.col("o_totalprice").alias("amount"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"))
    scores = _assessed(spark, sf_dir).select("applicant_id", "balance", "mean_score")
    joined = orders.join(lines, "order_id").join(scores, "applicant_id", "left")
    late = F.datediff("closed", "opened") > LATE_DAYS
    return joined.select("order_id", "opened", "lines", "amount", "quantity", "discount", "priority", (F.year("opened") * 12 + F.month("opened")).alias("month"), "balance", "mean_score", late.alias("late"))


def _late_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last fifth of the time with the probability that a model of the earlier ones gives them."""
    rows = materialize(order_features(spark, sf_dir), "order_features")  # read four times and more
    first, last = rows.agg(F.min(F.unix_date("opened")), F.max(F.unix_date("opened"))).first()
    cutoff = 0 if first is None else first + int(TRAINED_SHARE * (last - first))
    model = boosting.fit(rows.filter(F.unix_date("opened") < cutoff), ORDER_FEATURES, "late", "order_id")
    return rows.filter(F.unix_date("opened") >= cutoff).select("order_id", "late", "mean_score", model.probability().alias("probability"))


def late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of the last fifth of the time: whether they were late, and how probable that was by those before."""
    return _late_scored(spark, sf_dir).select("order_id", "late", F.round("probability", 6).alias("probability"))


def late_model_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the model and the mean of the six agents tell late orders apart, on orders that the model was not fitted on."""
    scored = _late_scored(spark, sf_dir).withColumn("risk", 1.0 - F.col("mean_score") / 100.0)
    by = {"boosted trees": "probability", "mean of six agents": "risk"}
    rows = [boosting.auc(scored, c, "late").select(F.lit(name).alias("model"), "n", "ones", "auc") for name, c in by.items()]
    return rows[0].unionByName(rows[1])


def supplier_contagion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the risk of rejected applicants comes to rest among applicants and suppliers, handed on along what is bought from whom."""
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), (F.col("l_suppkey") * 2 + 1).alias("supplier"), C.cents(F.col("l_extendedprice")).alias("amount"))
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") * 2).alias("applicant"))
    bought = lines.join(orders, "order_id").groupBy("applicant", "supplier").agg(F.sum("amount").cast("double").alias("weight"))
    bought = materialize(bought, "bought")  # both ways are read from it
    there, back = bought.toDF("src", "dst", "weight"), bought.select("supplier", "applicant", "weight").toDF("src", "dst", "weight")
    rejected = _assessed(spark, sf_dir).select((F.col("applicant_id") * 2).alias("node"), (F.col("decision") == "Reject").cast("double").alias("mass"))
    ranked = ranking.personalised_rank(there.unionByName(back), rejected, damping=CONTAGION, rounds=CONTAGION_ROUNDS, tolerance=0.0)
    kind = F.when(F.pmod("node", F.lit(2)) == 0, "A").otherwise("S")  # numbers on the way, since texts are longer: applicants are even, suppliers odd
    return ranked.select(F.concat(kind, F.shiftright("node", 1)).alias("node"), F.round("rank", 9).alias("rank"))


def _contagion_sql() -> str:
    """The rounds one after another."""
    rounds = "".join(
        f""", r{i + 1} AS (
          SELECT n.node, {CONTAGION} * coalesce(got, 0) + (1 - {CONTAGION} + {CONTAGION} * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM w))) * seed AS rank
          FROM n LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r{i} JOIN w ON src = node GROUP BY 1) g ON dst = node)"""
        for i in range(CONTAGION_ROUNDS)
    )
    return _BASE + f"""
        , b AS (SELECT 'A' || o_custkey AS applicant, 'S' || l_suppkey AS supplier, CAST(sum(CAST(round(CAST(l_extendedprice AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) * 100) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
        e AS (SELECT applicant AS src, supplier AS dst, weight FROM b UNION ALL SELECT supplier, applicant, weight FROM b),
        w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e),
        n AS (SELECT node, coalesce(any_value(mass), 0) / (SELECT count(*) FROM decided WHERE decision = 'Reject') AS seed
              FROM (SELECT src AS node, NULL AS mass FROM e UNION ALL SELECT 'A' || applicant_id, CASE WHEN decision = 'Reject' THEN 1.0::DOUBLE ELSE 0 END FROM decided) GROUP BY 1),
        r0 AS (SELECT node, seed AS rank FROM n){rounds}
        SELECT node, round(rank, 9) AS rank FROM r{CONTAGION_ROUNDS}"""


ORACLES = {
    "supplier_contagion": _contagion_sql(),
    "decision_attribution": _BASE + """
        , place AS (SELECT * FROM (VALUES ('Financial Health', 0), ('Cash Flow', 1), ('Fraud Risk', 2), ('Forecast', 3), ('Compliance', 4), ('Business Stability', 5)) t(agent_name, bit)),
        coalition AS (SELECT applicant_id, mask, round(avg(CASE WHEN (mask >> bit) & 1 = 1 THEN e ELSE 50 END), 6) AS mean FROM eff JOIN place USING (agent_name), range(64) r(mask) GROUP BY 1, 2),
        worth AS (SELECT applicant_id, mask, CASE WHEN mean > 70 THEN 2 WHEN mean > 50 THEN 1 ELSE 0 END AS v FROM coalition),
        share AS (
          SELECT applicant_id, agent_name, CAST(sum(CASE WHEN (mask >> bit) & 1 = 1 THEN v * factorial(CAST(bit_count(mask) - 1 AS INTEGER)) * factorial(CAST(6 - bit_count(mask) AS INTEGER))
                                                        ELSE -v * factorial(CAST(bit_count(mask) AS INTEGER)) * factorial(CAST(5 - bit_count(mask) AS INTEGER)) END) AS BIGINT) AS shares FROM worth, place GROUP BY 1, 2)
        SELECT applicant_id, agent_name, shares, round(shares / 720.0::DOUBLE, 6) AS shapley FROM share""",
}
QUERIES = {f.__name__: f for f in (decision_attribution, supplier_contagion, fraud_isolation, late_orders, late_model_quality)}
