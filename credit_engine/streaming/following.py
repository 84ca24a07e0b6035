"""Two streams joined in time: what each event was preceded by, with state that both watermarks bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preceded(events: DataFrame, earlier: DataFrame, key: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Every row of events with every row of `earlier` of its key that lies no more than `within` before it; of streams as of tables.

    Both have `ts` and their own columns beside the key; those of `earlier` are null where there is none. Of streams, a
    row is kept for as long as the other side may still bring one for it: of `earlier` until the watermark is `within`
    later, of events until the watermark has passed it, when it comes out unmatched, once. Rows more than `late` behind
    their stream are dropped. Null keys and times match nothing and stay unmatched, but a stream has no end at which a row
    without a time would come out.
    """
    then = earlier.withColumnsRenamed({key: "__key", "ts": "__ts"})
    first = events
    if events.isStreaming:
        first, then = first.withWatermark("ts", late), then.withWatermark("__ts", late)
    close = (F.col(key) == F.col("__key")) & (F.col("__ts") <= F.col("ts")) & (F.col("__ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    return first.join(then, close, "left").drop("__key").withColumnRenamed("__ts", "earlier_ts")
