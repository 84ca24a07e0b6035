"""Alerts for keys that fall silent, with a state of its own: what is not decided yet, by batch, and rows that come too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import delete, exists


def _gaps(events: DataFrame, key: str, quiet: int) -> Column:
    """Whether no event of the key follows within `quiet` microseconds."""
    following = F.lead("ts").over(W.partitionBy(key).orderBy("ts"))
    return following.isNull() | (F.unix_micros(following) - F.unix_micros("ts") > quiet)


def silences(events: DataFrame, key: str, quiet: int, late: int) -> DataFrame:
    """key and since: events of a table (key, ts) that none of their key follows within `quiet` microseconds, as far as the
    latest event of all, less `late`, lies beyond that. Events of one key and time are one; null keys are a key, null times
    are no events."""
    known = events.filter("ts IS NOT NULL").select(key, "ts").distinct()
    clock = known.agg((F.max(F.unix_micros("ts")) - late).alias("clock"))
    silent = known.select(key, "ts", _gaps(known, key, quiet).alias("gap")).filter("gap")
    # One row of a single number, which is a bound for a filter.
    end = clock.first()[0]
    return silent.filter(F.unix_micros("ts") + quiet < F.lit(end)).select(key, F.col("ts").alias("since"))


def watch(events: DataFrame, folder: str, key: str, quiet: int, late: int) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of events (key, ts) over what is there now; returns all silences so far (key, since) and all rows that came too late (key, ts).

    The clock is the latest event of the batches before, less `late`. A row behind it is late: it changes no alert and comes
    out beside. An event is decided when the clock has passed its time and `quiet`, for then no row that is not late can
    follow it; until then it is in the state, which so holds no more than the events of `quiet` and `late`. Alerts are
    those of `silences` over the rows that were not late, and never taken back. Each batch writes state, clock, alerts and
    late rows under its number, from the state of the batch before, so that a batch that is run again replaces itself, and
    a stream that is started again in the same folder goes on.
    """
    spark = events.sparkSession
    shape = events.select(key, "ts").schema
    place = lambda what, batch: f"{folder}/{what}/batch={batch}"

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.select(key, "ts").persist()
        held = spark.read.schema(shape).parquet(place("state", batch - 1)) if batch else spark.createDataFrame([], shape)
        before = spark.read.schema("latest long").parquet(place("clock", batch - 1)).first()[0] if batch else None
        newest = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
        latest = max((x for x in (before, newest) if x is not None), default=None)
        behind = F.unix_micros("ts") < F.lit(None if before is None else before - late)
        rows.filter(behind).write.mode("overwrite").parquet(place("late", batch))
        fresh = rows.filter(~F.coalesce(behind, F.lit(False)) & F.col("ts").isNotNull())
        known = held.unionByName(fresh).distinct()
        decided = F.unix_micros("ts") + quiet < F.lit(None if latest is None else latest - late)
        judged = known.select(key, "ts", _gaps(known, key, quiet).alias("gap"), F.coalesce(decided, F.lit(False)).alias("decided"))
        judged.filter("decided AND gap").select(key, F.col("ts").alias("since")).write.mode("overwrite").parquet(place("alerts", batch))
        judged.filter("NOT decided").select(key, "ts").write.mode("overwrite").parquet(place("state", batch))
        spark.createDataFrame([(latest,)], "latest long").coalesce(1).write.mode("overwrite").parquet(place("clock", batch))
        for what in ("state", "clock"):
            if batch >= 3:  # the two before stay, for a batch that is run again
                delete(spark, place(what, batch - 3))
        rows.unpersist()

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()

    def found(what: str, column: str) -> DataFrame:
        names = f"{shape[key].dataType.simpleString()}, {column} timestamp"
        schema = f"`{key}` {names}"
        return spark.read.schema(schema).parquet(f"{folder}/{what}").select(key, column) if exists(spark, f"{folder}/{what}") else spark.createDataFrame([], schema)

    return found("alerts", "since"), found("late", "ts")
