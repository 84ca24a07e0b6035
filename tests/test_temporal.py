"""As-of and overlap joins against loops, and their plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from credit_engine.operators import temporal


def cell(x):
    return (x is not None, x if x is not None else 0)


@pytest.fixture(scope="module")
def asof_rows():
    rng = random.Random(2)
    left = [(i, rng.choice(["a", "b", "hot", "hot", None]), rng.choice([None, *range(-20, 60)])) for i in range(300)] + [(1, "a", 5), (1, "a", 5), (900, "alone", 7)]
    right = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *range(-10, 50)]), rng.choice([None, 1, 2, 3])) for _ in range(150)] + [("hot", 30, None), ("b", -5, 9), ("b", -5, None)]
    return left, right


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(("bins", "tolerance"), [(1, None), (7, None), (1000, 3), (None, 0)])
def test_asof(spark, asof_rows, strict, bins, tolerance):
    left, right = asof_rows
    want = []
    for i, k, t in left:
        fits = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        best = max(fits, key=lambda r: (r[1], cell(r[2])), default=None)
        best = None if best is None or tolerance is not None and t - best[1] > tolerance else best
        want.append((i, k, t, best and best[1], best and best[2]))
    ldf, rdf = spark.createDataFrame(left, "id long, k string, t int").repartition(5), spark.createDataFrame(right, "state string, at long, v int").repartition(3)
    got = temporal.asof_join(ldf, rdf, {"k": "state"}, "t", "at", {"at": "seen", "v": "row"}, strict=strict, tolerance=tolerance, bins=bins)
    assert got.columns == ["id", "k", "t", "seen", "row"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_asof_of_times(spark):
    """Dates beside timestamps count as midnights; several keys; empty sides."""
    at = lambda d, h=0: dt.datetime(2020, 1, d, h)
    left = spark.createDataFrame([(1, "x", at(3)), (1, "x", at(3, 5)), (1, "y", at(9)), (2, "x", at(1))], "a long, b string, ts timestamp")
    right = spark.createDataFrame([(1, "x", dt.date(2020, 1, 3), 7.5, {"m": 1}), (1, "x", dt.date(2020, 1, 4), 8.5, {}), (2, "x", dt.date(2020, 1, 1), 9.5, None)], "a long, b string, day date, v double, other map<string,int>")
    both = {"a": "a", "b": "b"}
    got = temporal.asof_join(left, right, both, "ts", "day", {"v": "v"}, bins=3)
    assert sorted((r.a, r.b, r.ts, r.v) for r in got.collect() if r.v) == [(1, "x", at(3), 7.5), (1, "x", at(3, 5), 7.5), (2, "x", at(1), 9.5)] and got.count() == 4
    assert [r.v for r in temporal.asof_join(left, right, both, "ts", "day", {"v": "v"}, strict=True).collect() if r.v] == [7.5]
    assert temporal.asof_join(left, right.limit(0), both, "ts", "day", {"v": "v"}).filter("v IS NULL").count() == 4
    assert temporal.asof_join(left.limit(0), right, both, "ts", "day", {"v": "v"}).count() == 0
    with pytest.raises(ValueError, match="clash"):
        temporal.asof_join(left, right, both, "ts", "day", {"v": "TS"})
    with pytest.raises(ValueError, match="different kinds"):
        temporal.asof_join(left, right, both, "a", "day", {"v": "v"})


def test_asof_shuffles_each_side_once(spark):
    left, right = spark.range(1000).selectExpr("id", "id % 7 AS k", "id AS t"), spark.range(500).selectExpr("id % 7 AS k", "id AS t", "id AS v")
    joined = temporal.asof_join(left, right, {"k": "k"}, "t", "t", {"v": "v"}, bins=4)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "Arrow" not in plan
    rows = [x for x in plan.splitlines() if "Exchange hashpartitioning(k0" in x and "bin" in x]
    assert sum("Exchange" in x for x in rows) <= 4  # rows of both sides once, ends, bins of left, what is carried


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(4)

    def some(n, keys):
        out = []
        for i in range(n):
            a = rng.choice([None, *range(-100, 100)] + [rng.randint(-(10**6), 10**6)])
            size = rng.choice([0, 1, 1, 2, 5, 30, -3, 64, 65, 4097, 10**7, None])
            out.append((i, rng.choice(keys), a, None if a is None or size is None else a + size))
        return out

    return some(150, ["a", "b", "hot", None]), some(120, ["a", "hot", "hot", "c", None])


@pytest.mark.parametrize("step", [2, 64])
def test_overlaps(spark, spans, step, monkeypatch):
    monkeypatch.setattr(temporal, "STEP", step)
    left, right = spans
    left, right = left + left[:9], right + right[:5]
    ok = lambda s: s[1] is not None and s[2] is not None and s[3] is not None and s[2] < s[3]
    want = [(*x, y[0], y[2]) for x in left if ok(x) for y in right if ok(y) and x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3])]
    ldf, rdf = spark.createDataFrame(left, "bin long, k string, a long, b long").repartition(4), spark.createDataFrame(right, "id long, k string, a long, b long")
    got = temporal.overlap_join(ldf, rdf, {"k": "k"}, ("a", "b"), ("a", "b"), {"id": "id", "a": "since"})
    assert got.columns == ["bin", "k", "a", "b", "id", "since"] and len(want) > 500
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert temporal.overlap_join(ldf, rdf.limit(0), {"k": "k"}, ("a", "b"), ("a", "b"), {"id": "id"}).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_has_few_bins(spark):
    """A span that holds nearly all the length of a table does not make as many rows as there are narrow bins."""
    many = spark.range(2000).select(F.lit(1).alias("k"), "id", (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 1).alias("b"))
    one = spark.createDataFrame([(1, 7, 0, 10**12)], "k int, n long, a long, b long")
    assert temporal.overlap_join(many, one, {"k": "k"}, ("a", "b"), ("a", "b"), {"n": "n"}).count() == 2000
