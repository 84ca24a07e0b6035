"""Shapley values of a decision: what each agent adds to a label that is no sum of the agents."""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an agent that is left out counts as, and the worth of each label.
NEUTRAL = 50.0
MOST_PLAYERS = 12


def label_worth(score: Column) -> Column:
    """0 for Reject, 1 for Review, 2 for Approve; a missing or undefined score is worth nothing."""
    return F.when(score.isNull() | F.isnan(score), 0).when(score > 70.0, 2).when(score > 50.0, 1).otherwise(0).cast("bigint")


def coalitions(players: list[Column], worth: Callable[[Column], Column], neutral: float = NEUTRAL) -> Column:
    """The worth of every coalition, by its bit mask: that of the mean in which every other player counts as `neutral`.

    All 2**n coalitions stand on the row; more than MOST_PLAYERS players are an error. Keep it as a column of its own:
    each player's share reads all of it.
    """
    n = len(players)
    if not 1 <= n <= MOST_PLAYERS:
        raise ValueError(f"1 to {MOST_PLAYERS} players, not {n}")

    def of(e: Column) -> Column:
        def mean(mask: Column) -> Column:
            parts = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.element_at(e, i + 1)).otherwise(neutral) for i in range(n)]
            return F.round(sum(parts[1:], parts[0]) / float(n), 6)

        return F.transform(F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), mean), worth)

    # The players go through a transform, so that they are made once for all coalitions.
    return F.element_at(F.transform(F.array(F.array(*players)), of), 1)


def shapley(worths: Column, n: int) -> tuple[list[Column], int]:
    """A whole number for each of n players, and what they are shares of: the number divided by it is the player's Shapley value.

    Weights are whole numbers, so that the values add up exactly to the worth of all less the worth of none.
    """
    order = [factorial(k) * factorial(n - 1 - k) for k in range(n)]  # orders in which a player comes after k given others
    shares = []
    for i in range(n):
        weights = [order[m.bit_count() - 1] if m >> i & 1 else -order[m.bit_count()] for m in range(1 << n)]
        weighed = F.zip_with(worths, F.array(*[F.lit(w).cast("bigint") for w in weights]), lambda x, w: x * w)
        shares.append(F.aggregate(weighed, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return shares, factorial(n)


def attributed(names: list[str], worths: Column) -> Column:
    """An array of (agent_name, shares, shapley) from the column of coalitions; shares are of n!."""
    shares, whole = shapley(worths, len(names))
    return F.array(*[F.struct(F.lit(name).alias("agent_name"), x.alias("shares"), F.round(x / float(whole), 6).alias("shapley")) for name, x in zip(names, shares, strict=True)])
