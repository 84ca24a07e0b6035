"""Queries by time: what was known before, what ran at the same time, what comes next. Their SQL is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..models import forecast
from ..operators import profile, temporal
from ..sources import tables
from ..storage import new_path
from ..streaming import following, silence
from ..streaming import payments as stream
from .lending import _BASE

#: Filings older than this many days before an order say nothing of it.
STALE_DAYS = 365
#: Microseconds after which a user is silent, and that events may come late.
QUIET, LATE = 2 * 86_400_000_000, 600_000_000


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's revenue of each applicant, known from the month's end on."""
    months = profile.monthly(tables.ledger(spark, sf_dir))
    return months.select("applicant_id", "month", F.add_months("month", 1).alias("ended"), C.amount(F.col("revenue")).alias("revenue"))


def payment_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each digital payment with the last ledger month of its applicant that had ended by then."""
    paid = tables.payments(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("applicant_id"), "ts")
    found = temporal.asof_join(paid, _filed(spark, sf_dir), {"applicant_id": "applicant_id"}, "ts", "ended", {"month": "last_month", "revenue": "last_revenue"})
    return found.select("event_id", "applicant_id", "last_month", "last_revenue")


def order_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the last ledger month of its applicant that had ended by then, if that is no more than a year ago."""
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("applicant_id"), "o_orderdate")
    found = temporal.asof_join(
        orders, _filed(spark, sf_dir), {"applicant_id": "applicant_id"}, "o_orderdate", "ended", {"month": "last_month", "revenue": "last_revenue"}, tolerance=STALE_DAYS * 86_400_000_000
    )
    return found.drop("o_orderdate")


def filing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """applicant_id, gap_start and gap_end: the months without a filing between two filings of an applicant."""
    months = profile.monthly(tables.ledger(spark, sf_dir)).select("applicant_id", "month")
    following = F.lead("month").over(W.partitionBy("applicant_id").orderBy("month"))
    return months.select("applicant_id", F.add_months("month", 1).alias("gap_start"), following.alias("gap_end")).filter("gap_end > gap_start")


def gap_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filing gap with the orders whose credit ran in it, and for how many days of it."""
    credit = tables.credit_terms(spark, sf_dir)
    met = temporal.overlap_join(filing_gaps(spark, sf_dir), credit, {"applicant_id": "applicant_id"}, ("gap_start", "gap_end"), ("opened", "closed"), {"order_id": "order_id", "opened": "opened", "closed": "closed"})
    days = F.datediff(F.least("gap_end", "closed"), F.greatest("gap_start", "opened"))
    return met.select("applicant_id", "gap_start", "gap_end", "order_id", days.alias("days"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.series(profile.monthly(tables.ledger(spark, sf_dir)), "applicant_id", "month", C.amount(F.col("revenue")))


def revenue_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three months' revenue of each applicant by level, trend and season."""
    # Exploded by a constant: of an exploded column Spark infers a filter, and repeats all that the column is made of in it.
    told = forecast.seasonal(_series(spark, sf_dir)).select("applicant_id", "choice", "first_month", F.size("ys").alias("n"), "ahead", F.explode(F.sequence(F.lit(1), F.lit(forecast.HORIZON))).alias("h"))
    return told.select("applicant_id", "choice", F.add_months("first_month", F.col("n") + F.col("h") - 1).alias("month"), C.round2(F.element_at("ahead", F.col("h"))).alias("forecast"))


def forecast_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean squared errors of the last six months, forecast from the months before, by the season's and the straight line's forecast."""
    h = forecast.HELD_OUT
    rows = _series(spark, sf_dir).filter(F.size("ys") > 2 * h)
    both = forecast.straight(forecast.seasonal(rows, horizon=h, cut=h), horizon=h, cut=h)
    each = both.select("applicant_id", F.inline(F.arrays_zip(F.slice("ys", F.size("ys") - h + 1, F.lit(h)).alias("y"), "ahead", "line")))
    apart = {name: F.round(F.sqrt(F.avg(F.pow(F.round(F.col("y") - F.col(c), 2), 2.0))), 2) for name, c in (("seasonal_error", "ahead"), ("line_error", "line"))}
    return each.agg(F.count("*").alias("n"), *[x.alias(name) for name, x in apart.items()])


def purchase_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the clicks of their user in the hour before, from two streams, as far as their watermarks have closed them."""

    def side(kind: str, name: str) -> DataFrame:
        events = stream.read_stream(spark, sf_dir).filter(F.col("event_type") == kind)
        return events.select(F.col("event_id").alias(name), "user_id", "ts")

    joined = following.preceded(side("purchase", "purchase_id"), side("click", "click_id"), "user_id")
    return stream.append(joined.select("purchase_id", "user_id", "click_id", (F.unix_micros("ts") - F.unix_micros("earlier_ts")).alias("micros")))


def payment_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When users fell silent for two days, from a stream of all events with a state of its own."""
    events = stream.read_stream(spark, sf_dir).select("user_id", "ts")
    alerts, _ = silence.watch(events, new_path(spark, "silence"), "user_id", QUIET, LATE)
    return alerts.select("user_id", F.col("since").cast("timestamp_ntz").alias("since"))


_ASOF = """
, f AS (SELECT applicant_id, month, CAST(revenue AS DOUBLE) AS revenue, CAST(month + INTERVAL 1 MONTH AS TIMESTAMP) AS ended FROM monthly)"""
_SEASONAL = _BASE + f"""
, ends AS (SELECT applicant_id, min(month) AS first_month, max(month) AS last_month FROM monthly GROUP BY 1),
months AS (SELECT applicant_id, first_month, unnest(range(0, 1 + (year(last_month) - year(first_month)) * 12 + month(last_month) - month(first_month))) AS t FROM ends),
ys AS (SELECT x.applicant_id, x.first_month, t, coalesce(CAST(revenue AS DOUBLE), 0) AS y FROM months x LEFT JOIN monthly m ON m.applicant_id = x.applicant_id AND m.month = x.first_month + to_months(CAST(t AS INTEGER))),
sizes AS (SELECT applicant_id, any_value(first_month) AS first_month, count(*) AS n FROM ys GROUP BY 1),
grid AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)' for i, (a, b, g) in enumerate(forecast.GRID))}) t(choice, a, b, g)),
begun AS (
  SELECT applicant_id, avg(y) AS level FROM ys JOIN sizes USING (applicant_id) WHERE t < {{early}} AND t < {forecast.PERIOD} GROUP BY 1),
states AS (
  SELECT applicant_id, choice, a, b, g, CAST(-1 AS BIGINT) AS t, level, 0.0::DOUBLE AS trend, [{', '.join(['0.0::DOUBLE'] * forecast.PERIOD)}] AS season FROM begun CROSS JOIN grid
  UNION ALL
  SELECT applicant_id, choice, a, b, g, t, new_level, b * (new_level - level) + (1 - b) * trend,
         list_transform(range({forecast.PERIOD}), lambda i: CASE WHEN i = t % {forecast.PERIOD} THEN g * (y - new_level) + (1 - g) * season[i + 1] ELSE season[i + 1] END)
  FROM (SELECT s.applicant_id, choice, a, b, g, ys.t, ys.y, level, trend, season, a * (y - season[ys.t % {forecast.PERIOD} + 1]) + (1 - a) * (level + trend) AS new_level
        FROM states s JOIN ys ON ys.applicant_id = s.applicant_id AND ys.t = s.t + 1))
"""
_AHEAD = "level + h * trend + season[(t + h) % 12 + 1]"


def _chosen(cut: int, held_out: int = forecast.HELD_OUT) -> str:
    """The grid's place for each applicant whose last `cut` months are not looked at, and the state that the forecast goes on from."""
    n = f"(n - {cut})"
    early = f"CASE WHEN {n} > {held_out} THEN {n} - {held_out} ELSE {n} END"
    return _SEASONAL.replace("WITH cost AS", "WITH RECURSIVE cost AS", 1).replace("{early}", early) + f"""
, judged AS (
  SELECT s.applicant_id, choice, round(sum((y - ({_AHEAD.replace('t + h', 's.t + h')})) ** 2), 2) AS error
  FROM (SELECT s.*, n, unnest(range(1, {held_out + 1})) AS h FROM states s JOIN sizes USING (applicant_id) WHERE {n} > {held_out} AND s.t = {n} - {held_out} - 1) s JOIN ys ON ys.applicant_id = s.applicant_id AND ys.t = s.t + h GROUP BY 1, 2),
best AS (SELECT applicant_id, CAST(coalesce(first(choice ORDER BY error, choice), 0) AS INTEGER) AS choice FROM sizes LEFT JOIN judged USING (applicant_id) GROUP BY 1),
last AS (SELECT s.*, first_month, n FROM states s JOIN best USING (applicant_id, choice) JOIN sizes USING (applicant_id) WHERE s.t = n - {cut} - 1)"""


ORACLES = {
    "payment_silence": f"""
        SELECT user_id, ts AS since FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM (SELECT DISTINCT user_id, ts FROM events))
        WHERE (following IS NULL OR epoch_us(following) - epoch_us(ts) > {QUIET}) AND epoch_us(ts) + {QUIET} < (SELECT max(epoch_us(ts)) FROM events) - {LATE}""",
    "purchase_paths": """
        WITH p AS (SELECT event_id AS purchase_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, ts FROM events WHERE event_type = 'click'),
        j AS (SELECT purchase_id, p.user_id, p.ts, click_id, epoch_us(p.ts) - epoch_us(c.ts) AS micros FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 HOUR)
        SELECT purchase_id, user_id, click_id, micros FROM j WHERE click_id IS NOT NULL OR epoch_us(ts) // 1000 <= (SELECT least((SELECT max(epoch_us(ts)) FROM p), (SELECT max(epoch_us(ts)) FROM c)) // 1000 - 600000)""",
    "payment_asof": _BASE + _ASOF + """
        SELECT event_id, user_id AS applicant_id, f.month AS last_month, f.revenue AS last_revenue
        FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN f ON e.user_id = f.applicant_id AND e.ts >= f.ended""",
    "order_asof": _BASE + _ASOF + f"""
        SELECT o_orderkey AS order_id, o_custkey AS applicant_id, CASE WHEN date_diff('microsecond', ended, o_orderdate) <= {STALE_DAYS * 86_400_000_000} THEN f.month END AS last_month,
               CASE WHEN date_diff('microsecond', ended, o_orderdate) <= {STALE_DAYS * 86_400_000_000} THEN f.revenue END AS last_revenue
        FROM orders ASOF LEFT JOIN f ON o_custkey = f.applicant_id AND o_orderdate >= f.ended""",
    "filing_gaps": _BASE + """
        SELECT * FROM (SELECT applicant_id, CAST(month + INTERVAL 1 MONTH AS DATE) AS gap_start, lead(month) OVER (PARTITION BY applicant_id ORDER BY month) AS gap_end FROM monthly) WHERE gap_end > gap_start""",
    "gap_exposure": _BASE + """
        , gaps AS (SELECT * FROM (SELECT applicant_id, CAST(month + INTERVAL 1 MONTH AS DATE) AS gap_start, lead(month) OVER (PARTITION BY applicant_id ORDER BY month) AS gap_end FROM monthly) WHERE gap_end > gap_start),
        credit AS (SELECT o_orderkey AS order_id, o_custkey AS applicant_id, CAST(o_orderdate AS DATE) AS opened, CAST(max(l_shipdate) AS DATE) AS closed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
        SELECT gaps.applicant_id, gap_start, gap_end, order_id, CAST(date_diff('day', greatest(gap_start, opened), least(gap_end, closed)) AS INTEGER) AS days
        FROM gaps JOIN credit ON gaps.applicant_id = credit.applicant_id AND greatest(gap_start, opened) < least(gap_end, closed)""",
    "revenue_forecast": _chosen(0) + f"""
        SELECT applicant_id, choice, CAST(first_month + to_months(CAST(n + h - 1 AS INTEGER)) AS DATE) AS month, CAST(round(CAST({_AHEAD} AS DECIMAL(18,6)), 2) AS DOUBLE) AS forecast
        FROM (SELECT *, unnest(range(1, {forecast.HORIZON + 1})) AS h FROM last)""",
    "forecast_backtest": _chosen(forecast.HELD_OUT) + f"""
        , line AS (SELECT applicant_id, regr_slope(y, t::DOUBLE) AS slope, regr_intercept(y, t::DOUBLE) AS base FROM ys JOIN sizes USING (applicant_id) WHERE t < n - {forecast.HELD_OUT} GROUP BY 1)
        SELECT count(*) AS n, round(sqrt(avg(round(y - ({_AHEAD.replace('t + h', 'l.t + h')}), 2) ** 2)), 2) AS seasonal_error, round(sqrt(avg(round(y - (base + slope * (l.t + h)), 2) ** 2)), 2) AS line_error
        FROM (SELECT *, unnest(range(1, {forecast.HELD_OUT + 1})) AS h FROM last WHERE n > {2 * forecast.HELD_OUT}) l JOIN line USING (applicant_id) JOIN ys ON ys.applicant_id = l.applicant_id AND ys.t = l.t + h""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
