"""Money, clamping and labels, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Own code of the suggestion that a high rate adds.
RATE_WARNING = "high_rate_strains_repayment"


def known(x: Column) -> Column:
    """A number as a double; null for what is not a number, which would pass for the greatest of all."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def cents(x: Column) -> Column:
    """An amount in hundredths as a bigint, whose sums are exact and cheap; ties are cut at six decimals first, halves go away from zero; null for a missing or undefined amount."""
    x = known(x)
    millionths = F.floor(F.abs(x.cast("double")) * 1e6 + 0.5)
    return F.when(x < 0, -1).otherwise(1) * F.call_function("div", millionths + 5000, F.lit(10000).cast("bigint"))


def amount(cents: Column) -> Column:
    """Hundredths as a double."""
    return cents / 100.0


def round2(x: Column) -> Column:
    """Two decimals as a double, the same in any engine: ties are cut at six decimals first."""
    return F.round(x.cast("decimal(18,6)"), 2).cast("double")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """low..high; a missing or undefined value is null, which greatest and least alone would not grant."""
    return F.when(known(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def effective_score(agent: Column, score: Column) -> Column:
    """A low fraud risk is good, so that agent's score counts from the other end."""
    return F.when(agent == "Fraud Risk", 100.0 - score).otherwise(score)


def label(score: Column) -> Column:
    """Approve above 70, Review above 50, else Reject; of the unrounded score; null for a missing or undefined one."""
    return F.when(known(score).isNull(), None).when(score > 70.0, "Approve").when(score > 50.0, "Review").otherwise("Reject")


def drop_penalty(revenue_drop: Column) -> Column:
    """15 points for a drop above 10; a missing or undefined drop is none."""
    return F.when(F.coalesce(known(revenue_drop), F.lit(0.0)) > 10.0, 15.0).otherwise(0.0)


def is_high_rate(interest_rate: Column) -> Column:
    """Above 12; a missing or undefined rate is not."""
    return F.coalesce(known(interest_rate), F.lit(0.0)) > 12.0


def with_rate_warning(suggestions: Column, interest_rate: Column) -> Column:
    """An array of suggestions with the warning appended where the rate is high."""
    return F.when(is_high_rate(interest_rate), F.array_append(suggestions, F.lit(RATE_WARNING))).otherwise(suggestions)


def default(values: Column, key: str) -> Column:
    """A map's entry as a double; 0 where the key is absent."""
    return F.coalesce(F.try_element_at(values, F.lit(key)).cast("double"), F.lit(0.0))


def format_inr(amount: Column) -> Column:
    """Whole rupees, cut toward zero: the last three digits, then groups of two. A minus sign counts as a digit."""
    x = amount.cast("bigint").cast("string")
    pairs = F.reverse(F.rtrim(F.regexp_replace(F.reverse(F.left(x, F.length(x) - 3)), "(..)", "$1,"), F.lit(",")))
    return F.concat(F.lit("₹ "), F.when(F.length(x) <= 3, x).otherwise(F.concat(pairs, F.lit(","), F.right(x, F.lit(3)))))


def override(base: Column, params: Column) -> Column:
    """A map with another's entries laid over it; an explicit null overrides as well."""
    return F.map_zip_with(base, params, lambda k, x, y: F.when(F.map_contains_key(params, k), y).otherwise(x))


def emi(principal: Column, yearly_rate: Column, months: Column) -> Column:
    """The monthly payment of an annuity; a rate of zero divides evenly."""
    r = yearly_rate / 1200.0
    growth = F.pow(1.0 + r, months)
    return F.when(r == 0.0, principal / months).otherwise(principal * r * growth / (growth - 1.0))


def simulated_score(interest_rate: Column, revenue_growth: Column) -> Column:
    """85, a fifth of the growth and twice the rate's distance from 8.5, within 10..99, rounded."""
    return F.round(clamp(85.0 + revenue_growth / 5.0 - (interest_rate - 8.5) * 2.0, 10.0, 99.0)).cast("bigint")


def simulated_decision(interest_rate: Column, revenue_growth: Column) -> Column:
    return F.when((interest_rate > 15.0) | (revenue_growth < -10.0), "REJECTED").otherwise("APPROVED")


def simulated_insights(interest_rate: Column, revenue_growth: Column) -> Column:
    """Codes that apply: high_rate and early_warning may meet, within_thresholds stands alone."""
    codes = F.array(
        F.when(interest_rate > 15.0, "high_rate"),
        F.when(revenue_growth < 0.0, "early_warning"),
        F.when((interest_rate <= 15.0) & (revenue_growth >= 0.0), "within_thresholds"),
    )
    return F.filter(codes, lambda x: x.isNotNull())
