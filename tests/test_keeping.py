"""The versioned table against a dictionary, with batches that fail and repeat; sketches against exact answers."""

import random

import pytest
from pyspark.sql import functions as F

from credit_engine.operators import sketches
from credit_engine.sinks.versioned import VersionedTable
from credit_engine.storage import new_path

SCHEMA = "id long, month string, v double"


@pytest.fixture
def table(spark):
    return VersionedTable(spark, new_path(spark, "versions"), ["id", "month"], "month")


def state(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_are_a_dictionary(spark, table):
    rng = random.Random(1)
    want, history = {}, []
    with pytest.raises(ValueError, match="no version"):
        table.read()
    for batch in range(4):
        rows = [(rng.randrange(20), f"2020-0{rng.randint(1, 5 if batch else 3)}", rng.choice([None, rng.random()])) for _ in range(40)]
        once = {}
        for i, m, v in rows:
            once[i, m] = max((once.get((i, m)), v), key=lambda x: (x is not None, x or 0.0))
        want = want | once
        history.append(sorted(((*k, v) for k, v in want.items()), key=repr))
        assert table.upsert(spark.createDataFrame(rows, SCHEMA).repartition(3), f"b{batch}") == batch
    assert table.versions() == [0, 1, 2, 3]
    for batch, rows in enumerate(history):
        assert state(table.read(batch)) == rows
    assert state(table.read()) == history[-1]
    assert table.upsert(spark.createDataFrame([(1, "2020-01", 9.0)], SCHEMA), "b2") == 3  # taken before
    assert state(table.read()) == history[-1] and table.versions() == [0, 1, 2, 3]
    table.vacuum(2)
    assert table.versions() == [2, 3] and state(table.read(2)) == history[2] and state(table.read()) == history[3]


def test_failed_batches_change_nothing(spark, table, monkeypatch):
    good = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA)
    table.upsert(good, "good")
    before = state(table.read())
    broken = spark.createDataFrame([(1, "a", 5.0), (3, "c", 0.0)], SCHEMA).withColumn("v", F.when(F.col("v") == 0, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        table.upsert(broken, "next")
    assert state(table.read()) == before and table.versions() == [0]
    with pytest.raises(ValueError, match="rows without month"):
        table.upsert(spark.createDataFrame([(1, None, 1.0)], SCHEMA), "null")
    with pytest.raises(ValueError, match="columns differ"):
        table.upsert(good.withColumn("w", F.lit(1)), "wide")
    other = VersionedTable(spark, table.path, ["id", "month"], "month")
    real = table._latest
    monkeypatch.setattr(table, "_latest", lambda: 0)  # another writer was quicker
    other.upsert(spark.createDataFrame([(7, "b", 7.0)], SCHEMA), "other")
    with pytest.raises(RuntimeError, match="another writer"):
        table.upsert(spark.createDataFrame([(8, "b", 8.0)], SCHEMA), "late")
    monkeypatch.setattr(table, "_latest", real)
    assert table.upsert(spark.createDataFrame([(8, "b", 8.0)], SCHEMA), "late") == 2  # tried again on what is there now
    assert state(table.read()) == sorted([*before, (7, "b", 7.0), (8, "b", 8.0)], key=repr)


def test_an_upsert_writes_its_partitions_only(spark, table):
    table.upsert(spark.createDataFrame([(i, f"m{i % 5}", 1.0) for i in range(50)], SCHEMA), "all")
    table.upsert(spark.createDataFrame([(0, "m0", 2.0)], SCHEMA), "one")
    folders = {name: {n: folder for kind, n, folder in table._manifest(v) if kind == "partition"} for v, name in ((0, "old"), (1, "new"))}
    assert {n for n in folders["old"] if folders["old"][n] != folders["new"][n]} == {"m0"}
    empty = spark.createDataFrame([], SCHEMA)
    assert table.upsert(empty, "none") == 2 and state(table.read(2)) == state(table.read(1))


def test_sketches(spark):
    """Merged months answer as the whole does, within the bounds; nulls are in neither."""
    rng = random.Random(5)
    rows = [(f"m{rng.randrange(12)}", rng.randrange(8000), rng.lognormvariate(0, 2)) for _ in range(60_000)] + [("m3", None, None), ("m3", None, float("nan")), ("nulls", None, None)]
    df = spark.createDataFrame(rows, "month string, who long, x double").repartition(6)
    stored = sketches.sketched(df, ["month"], "who", "x")
    wanted = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    whole = sketches.told(sketches.merged(stored.filter("month <> 'nulls'"), {"all": F.lit(1)}), wanted).first()
    assert whole.n == 60_002
    distinct, values = len({r[1] for r in rows if r[1] is not None}), sorted(r[2] for r in rows[:60_000])
    assert abs(whole.distinct - distinct) <= sketches.DISTINCT_ERROR * distinct
    for name, q in wanted.items():
        rank = sum(v <= whole[name] for v in values) / len(values)
        assert abs(rank - q) <= sketches.RANK_ERROR
    by_month = {r.month: r for r in sketches.told(stored, wanted).collect()}
    assert by_month["nulls"].distinct == 0 and by_month["nulls"].p50 is None and len(by_month) == 13
    assert sketches.told(sketches.sketched(df.limit(0), ["month"], "who", "x"), wanted).count() == 0
