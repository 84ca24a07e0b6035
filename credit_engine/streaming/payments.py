"""Digital payments as a stream: tumbling days by type, and sessions by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import amount, cents
from ..storage import new_path

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; event time is cast, since a watermark needs a time with a zone."""
    return spark.readStream.schema(SCHEMA).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n and value of tumbling days; of a stream as of a table."""
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = counted.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(cents(F.col("value"))).alias("v"))
    return grouped.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", amount(F.col("v")).alias("value"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """user_id, started, n_events and micros (its length) of each session: events of a user no gap or more apart."""
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = counted.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return grouped.select("user_id", F.col("a").cast("timestamp_ntz").alias("started"), "n_events", (F.unix_micros("b") - F.unix_micros("a")).alias("micros"))


def _folder(spark: SparkSession) -> str:
    """A folder of its own for a stream's rows and state, which storage.clear deletes with all others of the application."""
    return new_path(spark, "stream")


def append(df: DataFrame) -> DataFrame:
    """Runs a stream over what is there now and returns what the watermark has closed, from a Parquet sink; state of closed windows is dropped."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    started = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def upsert(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream over what is there now and returns the latest row of each key, open windows included.

    Every batch writes the rows that it changed as Parquet, under its number, so a batch that is run again replaces
    itself; the last row of a key counts. Nothing passes through the driver.
    """
    spark, folder = df.sparkSession, _folder(df.sparkSession)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.parquet(f"{folder}/rows")
    rest = [c for c in df.columns if c not in keys]
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return last.select(*[F.col(c) if c in keys else F.col(f"x.{c}") for c in df.columns])
