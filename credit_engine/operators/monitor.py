"""What happens in pipeline runs as an append-only log; the state of the pipeline is an aggregate of it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "seq bigint, millis double, event string, stage string, again boolean"


class RunLog:
    """Rows of EVENTS in their order: begin and end of runs, enter, leave and fail of stages.

    Nothing is ever changed or reset, so several runs may share a log: what earlier ones completed or retried stays in
    the state. `again` marks failures that another attempt follows.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[int, float, str, str | None, bool]] = []

    def add(self, event: str, stage: str | None = None, again: bool = False) -> None:
        self.rows.append((len(self.rows), time.monotonic() * 1000, event, stage, again))

    @contextmanager
    def run(self) -> Iterator[None]:
        self.add("begin")
        try:
            yield
        finally:
            self.add("end")

    def attempt(self, stage: str, work: Callable[[], Any], retries: int = 0) -> Any:
        """The result of work, tried again as often as `retries` says; the last failure is raised."""
        for left in range(retries, -1, -1):
            self.add("enter", stage)
            try:
                done = work()
            except Exception:
                self.add("fail", stage, again=left > 0)
                if not left:
                    raise
            else:
                self.add("leave", stage)
                return done
        return None

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, EVENTS)


def status(events: DataFrame) -> DataFrame:
    """One row: the state that a log of EVENTS adds up to, whatever the order of its rows; that of no events is Initialized.

    Health is Healthy from a begin on, Degraded after a failure that is tried again, Failed after any other one; a run
    that ends has completed unless it is Failed.
    """

    def last(value, when):
        """Of the latest row for which `when` holds; a struct, so that a null value counts as well."""
        return F.max_by(F.when(when, F.struct(value.alias("x"))), F.when(when, F.col("seq")))["x"]

    event, stage = F.col("event"), F.col("stage")
    health = last(F.when(event == "begin", "Healthy").when(F.col("again"), "Degraded").otherwise("Failed"), event.isin("begin", "fail"))
    moment = last(F.when(event == "begin", "Starting").when(event == "enter", stage), event.isin("begin", "enter", "end"))
    ended = last(event == "end", event.isin("begin", "enter", "end"))
    left = F.array_sort(F.collect_list(F.when(event == "leave", F.struct("seq", "stage"))))
    begun, over = last(F.col("millis"), event == "begin"), last(F.col("millis"), event == "end")
    added = events.agg(
        health.alias("health"), moment.alias("moment"), ended.alias("ended"), left.alias("left"), last(F.when(event == "enter", stage), event.isin("enter", "leave", "fail")).alias("running_stage"),
        last(stage, event == "fail").alias("failed_stage"), F.count_if((event == "fail") & F.col("again")).cast("int").alias("retry_count"), (over - begun).alias("took"),
    )
    healthy = F.coalesce("health", F.lit("Healthy"))
    current = F.when(F.col("ended"), F.when(healthy == "Failed", "Failed").otherwise("Completed")).otherwise(F.coalesce("moment", F.lit("Initialized")))
    return added.select(
        current.alias("current_stage"), F.transform("left", lambda x: x["stage"]).alias("completed_stages"), "running_stage", "failed_stage", "retry_count",
        F.when(F.col("ended"), F.col("took")).otherwise(0.0).alias("execution_time_ms"), healthy.alias("pipeline_health"),
    )


def run_stages(log: RunLog, stages: list[tuple[str, Callable[[Any], Any]]], given: Any, retries: int = 0) -> Any:
    """What the stages make of `given`, each of what the one before it made. Stages that only build plans are done when these stand."""
    with log.run():
        for name, stage in stages:
            made = given
            given = log.attempt(name, lambda stage=stage, made=made: stage(made), retries)
    return given
