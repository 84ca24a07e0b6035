"""Forecasts of monthly series by level, trend and season; the series of a batch are folded together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = 12
#: Smoothing of level, trend and season to choose from; of equals the first one counts.
GRID = [(a, b, g) for a in (0.05, 0.2) for b in (0.0, 0.05) for g in (0.0, 0.1)]
#: Months that are told, and months held out to choose the smoothing by.
HORIZON, HELD_OUT = 3, 6


def series(monthly: DataFrame, key: str, month: str, value: Column) -> DataFrame:
    """key, first_month and ys: the values of all months from the key's first one to its last; a month without rows is 0."""
    rows = monthly.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(month), value))).alias("of"), F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    months = F.sequence("first_month", "last_month", F.expr("INTERVAL 1 MONTH"))
    return rows.select(key, "first_month", F.transform(months, lambda m: F.coalesce(F.try_element_at("of", m), F.lit(0.0))).alias("ys"))


def _ahead(level: np.ndarray, trend: np.ndarray, season: np.ndarray, n: int, horizon: int) -> np.ndarray:
    """The forecasts of the next months after a state of n months, along the last axis."""
    return np.stack([level + float(h) * trend + season[(n + h - 1) % PERIOD] for h in range(1, horizon + 1)], axis=-1)


def _fold(ys: np.ndarray, held: int, horizon: int, grid: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Of series of one length (a row each): the squared error in the last `held` months and the forecasts of the next ones,
    by series and smoothing. All series and smoothings go from month to month together; there is no sum over an axis, so
    that doubles are added in the order of the months."""
    a, b, g = (np.array(x) for x in zip(*grid, strict=True))
    n = ys.shape[1]
    first = min(PERIOD, n - held)
    total = np.zeros((len(ys), 1))
    for t in range(first):
        total = total + ys[:, t : t + 1]
    level = np.repeat(total / first, len(grid), axis=1)
    trend, season, error = np.zeros_like(level), [np.zeros_like(level)] * PERIOD, np.zeros_like(level)
    for t in range(n):
        if t == n - held:
            told = _ahead(level, trend, season, t, held)
            for h in range(held):
                apart = ys[:, t + h, None] - told[:, :, h]
                error = error + apart * apart
        y, place = ys[:, t : t + 1], t % PERIOD
        before, level = level, a * (y - season[place]) + (1.0 - a) * (level + trend)
        trend = b * (level - before) + (1.0 - b) * trend
        season[place] = g * (y - level) + (1.0 - g) * season[place]
    return error, _ahead(level, trend, season, n, horizon)


def _told(horizon: int, held_out: int, grid: list[tuple[float, float, float]]):
    """Batches with the known values as the last column to the errors and forecasts of every smoothing in its place; null where no value is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(batch.num_columns - 1)
            sizes = known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values, ends = known.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            errors, ahead = np.zeros((len(sizes), len(grid))), np.zeros((len(sizes), len(grid), horizon))
            for n in np.unique(sizes[sizes > 0]).tolist():  # series of one length together; no batch has more lengths than rows
                rows = np.flatnonzero(sizes == n)
                ys = values[(ends[rows] - n)[:, None] + np.arange(n)]
                errors[rows], ahead[rows] = _fold(ys, held_out if n > held_out else 0, horizon, grid)
            none = pa.array(sizes == 0)
            out = (
                pa.ListArray.from_arrays(_offsets(sizes > 0, len(grid)), errors[sizes > 0].ravel(), mask=none),
                pa.ListArray.from_arrays(_offsets(sizes > 0, len(grid) * horizon), ahead[sizes > 0].ravel(), mask=none),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*batch.schema.names[:-1], "__errors", "__aheads"])

    return run


def _offsets(there: np.ndarray, size: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(there) * size]), pa.int32())


def seasonal(rows: DataFrame, horizon: int = HORIZON, held_out: int = HELD_OUT, cut: int = 0, grid: list[tuple[float, float, float]] = GRID) -> DataFrame:
    """rows (with ys) and `choice`, the place of the smoothing in the grid, and `ahead`, the forecasts of the next months.

    The last `cut` values are not looked at, and months are those after the rest. The smoothing is the one of the least
    squared error (to cents) in the last `held_out` months when these are forecast from the months before; series too
    short for that take the first of the grid. Series without a value left, or with a null, have null for both. Additive: level, trend
    and a season of PERIOD months, all on the row, so that nothing is shuffled; the series of a batch that are of one
    length are folded together.
    """
    n = F.size("ys") - cut
    known = rows.withColumn("__known", F.when((n > 0) & ~F.exists("ys", lambda y: y.isNull()), F.slice("ys", 1, n)))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    told = known.mapInArrow(_told(horizon, held_out, grid), ", ".join([*given, "__errors array<double>", "__aheads array<double>"]))
    rounded = told.withColumn("__errors", F.transform("__errors", lambda x: F.round(x, 2)))
    chosen = rounded.withColumn("choice", F.array_position("__errors", F.array_min("__errors")).cast("int") - 1)
    ahead = F.slice("__aheads", F.col("choice") * horizon + 1, F.lit(horizon))
    return chosen.select(*[f"`{c}`" for c in rows.columns], "choice", ahead.alias("ahead"))


def straight(rows: DataFrame, horizon: int = HORIZON, cut: int = 0) -> DataFrame:
    """rows (with ys) and `line`: the next months on the straight line of least squares, for comparison; a single value goes on."""
    n = (F.size("ys") - cut).cast("double")
    known = F.slice("ys", 1, F.greatest(F.size("ys") - cut, F.lit(0)))
    sums = F.aggregate(F.transform(known, lambda y, i: F.struct(y.alias("y"), (i * y).alias("iy"))), F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("iy")), lambda s, x: F.struct((s["y"] + x["y"]).alias("y"), (s["iy"] + x["iy"]).alias("iy")))
    held = rows.withColumns({"__s": sums, "__n": n})
    mean, middle = F.col("__s.y") / F.col("__n"), (F.col("__n") - 1.0) / 2.0
    slope = F.coalesce(F.try_divide(F.col("__s.iy") - middle * F.col("__s.y"), F.col("__n") * (F.col("__n") * F.col("__n") - 1.0) / 12.0), F.lit(0.0))
    line = F.when(F.col("__n") > 0, F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: mean + slope * (F.col("__n") - 1.0 + h - middle)))
    return held.select(*[f"`{c}`" for c in rows.columns], line.alias("line"))
