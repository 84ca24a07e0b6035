"""Joins by time that Spark has no operator for: the last row before (as-of), and spans that overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of both sides that share a time bin of an as-of join on average, and how many bins there may be.
ROWS_A_BIN, MOST_BINS = 1_000_000, 10_000
#: Bins of one level that a span may take before it goes to the next level, whose bins are as many times wider.
STEP = 64


def ticks(time: Column, kind: str) -> Column:
    """A time as a long: microseconds of timestamps, days of dates, whole numbers as they are."""
    if kind.startswith("timestamp"):
        return F.unix_micros(time.cast("timestamp"))
    if kind == "date":
        return F.unix_date(time).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return time.cast("long")
    raise ValueError(f"no time of a join: {kind}")


def _kind(df: DataFrame, column: str) -> str:
    return df.select(F.col(f"`{column}`")).schema[0].dataType.simpleString()


def _ticks_of(sides: list[tuple[DataFrame, str]]) -> list[Column]:
    """The times of several frames in one unit; dates beside timestamps count as their midnights."""
    kinds = [_kind(df, c) for df, c in sides]
    classes = {"timestamp" if k.startswith("timestamp") else "date" if k == "date" else "number" for k in kinds}
    if len(classes) > 1 and "number" in classes:
        raise ValueError(f"times of different kinds: {kinds}")
    mixed = len(classes) > 1
    return [ticks(F.col(f"`{c}`").cast("timestamp"), "timestamp") if mixed else ticks(F.col(f"`{c}`"), k) for (_, c), k in zip(sides, kinds, strict=True)]


def _named(left: DataFrame, columns: dict[str, str]) -> None:
    taken = {c.lower() for c in left.columns}
    if clash := [c for c in columns.values() if c.lower() in taken] or len({c.lower() for c in columns.values()}) < len(columns):
        raise ValueError(f"names of the result clash: {clash}")


def asof_join(
    left: DataFrame, right: DataFrame, on: dict[str, str], left_time: str, right_time: str, columns: dict[str, str],
    strict: bool = False, tolerance: int | None = None, bins: int | None = None,
) -> DataFrame:
    """Every row of left with columns of the last row of right that has its keys and is not after it; nulls where there is none.

    `on` maps left's keys to right's, `columns` right's columns to their names in the result. With `strict` the right row
    is before the left one, else it may be of the same time. `tolerance` (microseconds, days of dates, or the times' own
    unit) is the most that may lie between. Of right rows of one key and time the greatest by `columns` counts. Null keys
    and null times match nothing; left rows with them stay. Left rows that repeat stay repeated, right ones match once.

    Both sides are dealt once, by keys and time bin, so that a key with very many rows is split unless all of them are of
    one time. Bins hand on their last state through a table of one row for each key and bin. `bins` is found from the
    number of rows if it is not given.
    """
    _named(left, columns)
    t_left, t_right = _ticks_of([(left, left_time), (right, right_time)])
    keys = [f"k{i}" for i in range(len(on))]
    rows = left.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], t_left.alias("t"), F.struct(*[f"`{c}`" for c in left.columns]).alias("row"))
    payload = F.struct(t_right.alias("at"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    states = right.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on.values(), keys, strict=True)], t_right.alias("t"), payload.alias("state")).dropna(subset=[*keys, "t"])
    whole = F.lit(True)
    for k in (*keys, "t"):
        whole = whole & F.col(k).isNotNull()
    given, apart = rows.filter(whole), rows.filter(~whole)

    low, high, n = given.select("t").unionByName(states.select("t")).agg(F.min("t"), F.max("t"), F.count("*")).first()
    bins = bins or min(MOST_BINS, 1 + n // ROWS_A_BIN)
    width = max(1, math.ceil(((high or 0) - (low or 0) + 1) / bins))
    bin_of = F.floor((F.col("t") - F.lit(low or 0)) / F.lit(width)).cast("int").alias("bin")
    given, states = given.select("*", bin_of), states.select("*", bin_of)

    nothing = F.lit(None)
    both = given.select(*keys, "bin", "t", F.lit(1).alias("turn"), "row", nothing.cast(states.schema["state"].dataType).alias("state")).unionByName(
        states.select(*keys, "bin", "t", F.lit(2 if strict else 0).alias("turn"), nothing.cast(rows.schema["row"].dataType).alias("row"), "state")
    )
    before = W.partitionBy(*keys, "bin").orderBy("t", "turn", "state").rowsBetween(W.unboundedPreceding, 0)
    here = both.select(*keys, "bin", "t", "turn", "row", F.last("state", ignorenulls=True).over(before).alias("found")).filter("turn = 1")
    # What earlier bins leave to a bin: one row for each key and bin, a key has no more of them than there are bins.
    ends = states.groupBy(*keys, "bin").agg(F.max("state").alias("end"))
    every = given.select(*keys, "bin").distinct().withColumn("end", nothing.cast(states.schema["state"].dataType)).unionByName(ends)
    earlier = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    carried = every.groupBy(*keys, "bin").agg(F.max("end").alias("end")).select(*keys, "bin", F.last("end", ignorenulls=True).over(earlier).alias("carried")).filter("carried IS NOT NULL")
    joined = here.join(carried, [*keys, "bin"], "left").select("row", "t", F.coalesce("found", "carried").alias("state"))
    if tolerance is not None:
        joined = joined.withColumn("state", F.when(F.col("t") - F.col("state.at") <= tolerance, F.col("state")))
    every = joined.select("row", "state").unionByName(apart.select("row", nothing.cast(states.schema["state"].dataType).alias("state")))
    return every.select("row.*", *[F.col(f"state.c{i}").alias(c) for i, c in enumerate(columns.values())])


def overlap_join(left: DataFrame, right: DataFrame, on: dict[str, str], left_span: tuple[str, str], right_span: tuple[str, str], columns: dict[str, str]) -> DataFrame:
    """Every pair of a left and a right row of the same keys whose spans overlap: left's columns and `columns` of right.

    Spans are half-open: they hold their begin and not their end. Spans that are empty, reversed or open at a null end,
    and null keys, overlap nothing. Rows that repeat pair up each.

    Spans are dealt by keys and time bin. The narrowest bins are as wide as spans are long on average; spans of over STEP
    bins go by bins STEP times wider, and so on, so that a span has few bins however long it is. Every span also stands in
    the wider bins, and a pair meets where the wider of the two lies, in the bin where the later one begins.
    """
    _named(left, columns)
    (l0, l1), (r0, r1) = left_span, right_span
    begins_ends = _ticks_of([(left, l0), (left, l1), (right, r0), (right, r1)])
    keys = [f"k{i}" for i in range(len(on))]

    def spans(df: DataFrame, names, begin: Column, end: Column, side: str, given) -> DataFrame:
        row = [F.col(f"`{c}`").alias(f"{side}_c{i}") for i, c in enumerate(given)]
        found = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, keys, strict=True)], begin.alias("a"), end.alias("b"), *row)
        return found.dropna(subset=[*keys, "a", "b"]).filter("a < b")

    sides = [spans(left, on, *begins_ends[:2], "l", left.columns), spans(right, on.values(), *begins_ends[2:], "r", columns)]
    length = F.col("b") - F.col("a")
    mean, longest = sides[0].select("a", "b").unionByName(sides[1].select("a", "b")).agg(F.avg(length), F.max(length)).first()
    width = max(1, math.ceil(mean or 1))
    widths = [width]
    while widths[-1] * STEP < (longest or 1):
        widths.append(widths[-1] * STEP)

    def placed(spans: DataFrame, side: str) -> DataFrame:
        own = sum((F.when(length > w * STEP, 1).otherwise(0) for w in widths[:-1]), F.lit(0)).cast("int")
        levels = F.filter(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(w).cast("long").alias("width")) for i, w in enumerate(widths)]), lambda x: x["level"] >= F.col("own"))
        each = spans.select("*", own.alias("own")).select("*", F.inline(levels))
        bins = F.sequence(F.floor(F.col("a") / F.col("width")), F.floor((F.col("b") - 1) / F.col("width")))
        rest = [c for c in spans.columns if c.startswith(f"{side}_")]
        return each.select(*keys, "level", F.explode(bins).alias("bin"), "width", *[F.col(c).alias(f"{side}_{c}") for c in ("own", "a", "b")], *rest)

    met = placed(sides[0], "l").join(placed(sides[1], "r").drop("width"), [*keys, "level", "bin"])
    later = F.greatest("l_a", "r_a")
    pairs = met.filter((F.greatest("l_own", "r_own") == F.col("level")) & (F.floor(later / F.col("width")) == F.col("bin")) & (later < F.least("l_b", "r_b")))
    return pairs.select(*[F.col(f"l_c{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"r_c{i}").alias(c) for i, c in enumerate(columns.values())])
