"""Streams of several batches, with late rows and a restart, against the table join."""

import datetime as dt
import random

from pyspark.sql import functions as F

from credit_engine.storage import new_path
from credit_engine.streaming import following

SCHEMA = "id long, who long, ts timestamp"


def test_two_streams(spark, tmp_path):
    """Batches in order of time, some rows a little late, a restart between: matches come out once, unmatched rows once they are closed."""
    rng = random.Random(4)
    begin = dt.datetime(2024, 1, 1)
    rows = {kind: [(i, rng.randrange(6), begin + dt.timedelta(seconds=rng.randrange(6 * 3600))) for i in range(n)] for kind, n in (("first", 150), ("then", 120))}
    rows["first"] += [(900, None, begin + dt.timedelta(hours=1)), (901, 3, None)]
    for kind, found in rows.items():
        found.sort(key=lambda r: (r[2] or begin) + dt.timedelta(seconds=rng.randrange(500)))  # at most 500 seconds late, 600 are waited for
        for batch in range(6):
            part = found[batch * len(found) // 6 : (batch + 1) * len(found) // 6]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{kind}/{batch}")
    folder = new_path(spark, "stream")

    def run(batches):
        """All batches so far; the stream goes on from its checkpoint."""
        sides = {}
        for kind in rows:
            for batch in range(batches):
                target = tmp_path / "in" / kind / f"{batch}.parquet"
                target.parent.mkdir(parents=True, exist_ok=True)
                if not target.exists():
                    (source,) = (tmp_path / kind / str(batch)).glob("*.parquet")
                    source.rename(target)
            sides[kind] = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{kind}")
        then = sides["then"].withColumnRenamed("id", "then_id")
        joined = following.preceded(sides["first"], then, "who").select("id", "who", "then_id")
        joined.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{folder}/rows").collect()), key=repr)

    early = run(3)
    got = run(6)
    tables = [spark.createDataFrame(rows[kind], SCHEMA) for kind in ("first", "then")]
    every = following.preceded(tables[0], tables[1].withColumnRenamed("id", "then_id"), "who")
    want = sorted(map(tuple, every.select("id", "who", "then_id").collect()), key=repr)
    ends = min(max(r[2] for r in found if r[2]) for found in rows.values()) - dt.timedelta(minutes=10)
    closed = {r[0] for r in rows["first"] if r[2] and r[2] < ends}
    assert len(got) == len(set(got)) and set(early) <= set(got) <= set(want)
    matched = {r for r in want if r[2] is not None}
    assert matched <= set(got) and len(matched) > 50
    assert {r for r in want if r[2] is None and r[0] in closed} <= set(got) and {r[0] for r in got if r[2] is None} - closed <= {r[0] for r in rows["first"] if r[2] and r[2] == ends}
    assert every.filter("id >= 900 AND then_id IS NULL").count() == 2 and every.filter(F.col("then_id").isNull()).count() > 10


def test_silence(spark, tmp_path):
    """Six batches with rows that are late and too late, and a restart: alerts are those of the table without the late rows, which all come out beside."""
    from credit_engine.streaming import silence

    rng = random.Random(6)
    begin, quiet, late = dt.datetime(2024, 1, 1), 3_600_000_000, 600_000_000
    rows = sorted([(rng.choice([None, *range(5)]), begin + dt.timedelta(seconds=rng.randrange(20 * 3600))) for _ in range(160)], key=lambda r: r[1])
    batches = [rows[i * 27 : (i + 1) * 27] for i in range(6)]
    for i in range(1, 6):  # a little late, much too late, repeated, without a time
        batches[i].append((0, batches[i][0][1] - dt.timedelta(seconds=300)))
        batches[i] += [(1, batches[i][0][1] - dt.timedelta(hours=3)), batches[i][3], (2, None)]
    clock, on_time, beside = None, [], []
    for batch in batches:
        for r in batch:
            (beside if r[1] and clock and r[1] < clock else on_time).append(r)
        clock = max(r[1] for r in on_time if r[1]) - dt.timedelta(microseconds=late)
    assert len(beside) >= 4
    source, folder = tmp_path / "in", new_path(spark, "silence")
    source.mkdir()
    (tmp_path / "made").mkdir()

    def run(upto):
        for i in range(upto):
            if not (source / f"{i}.parquet").exists():
                spark.createDataFrame(batches[i], "who long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/made/{i}")
                (made,) = (tmp_path / "made" / str(i)).glob("*.parquet")
                made.rename(source / f"{i}.parquet")
        events = spark.readStream.schema("who long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
        return silence.watch(events, folder, "who", quiet, late)

    run(1), run(4)
    alerts, too_late = run(6)
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = plain(silence.silences(spark.createDataFrame(on_time, "who long, ts timestamp"), "who", quiet, late))
    assert plain(alerts) == want and len(want) > 5
    assert plain(too_late) == sorted(beside, key=repr)
    again, _ = silence.watch(spark.readStream.schema("who long, ts timestamp").parquet(str(source)), folder, "who", quiet, late)
    assert plain(again) == want  # nothing new, nothing twice
