"""Distinct counts and quantiles of months as sketches that are stored and merged to any span, without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the registers of a distinct count, whose relative error is about 1.04 / sqrt(2**bits); size of a quantile sketch.
BITS, SIZE = 12, 400
#: Errors that are not exceeded but by great bad luck: of a distinct count, relative, and of a quantile, in rank.
DISTINCT_ERROR, RANK_ERROR = 0.06, 0.02


def sketched(rows: DataFrame, by: list[str], counted: str, valued: str) -> DataFrame:
    """by, n, `distinct` and `values`: the number of rows of each group, a sketch of the distinct `counted`, one of `valued`.

    Nulls are in neither sketch, and undefined values are none; a group of nulls alone has empty sketches. Sketches are
    built before the shuffle, so that a large group sends one of each per task.
    """
    value = F.nanvl(F.col(valued).cast("double"), F.lit(None).cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(counted), BITS).alias("distinct"), F.kll_sketch_agg_double(value, SIZE).alias("values"))


def merged(sketches: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Sketches of groups (n, distinct, values) merged to the groups `by`, columns by name."""
    return sketches.groupBy(*[x.alias(c) for c, x in by.items()]).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("values", SIZE).alias("values"))


def told(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Sketches with their answers: `distinct` as a number and each quantile under its name, null for no values."""
    some = F.kll_sketch_get_n_double("values") > 0
    answers = [F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(q))).alias(c) for c, q in quantiles.items()]
    rest = [c for c in sketches.columns if c not in ("distinct", "values")]
    return sketches.select(*rest, F.hll_sketch_estimate("distinct").alias("distinct"), *answers)
