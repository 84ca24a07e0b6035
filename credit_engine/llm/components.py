"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import delete, new_path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and component (the smallest node reachable) of every node with an edge to another one.

    Edges count in both directions; repeated edges, loops and edges with a null end change nothing. Every round's edges
    are written to the shared folder, so that neither lineage nor the driver grows with the graph. A node with very many
    edges meets a minimum that is summed up before the shuffle and a join that Spark may split.
    """
    spark = edges.sparkSession
    u, v = F.col(f"`{src}`"), F.col(f"`{dst}`")
    current = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    path, seen = None, None
    while True:
        fresh = new_path(spark, "edges")
        current.write.parquet(fresh)
        held = spark.read.schema(current.schema).parquet(fresh)
        if path:
            delete(spark, path)
        path = fresh
        state = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        current, seen = _small_star(_large_star(held)), state
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(held.select("v", "v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()
