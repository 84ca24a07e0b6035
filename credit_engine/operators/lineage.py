"""All that comes before each node of a graph: reach, longest paths and cycles, in rounds that handle what is new alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def reach(edges: DataFrame) -> DataFrame:
    """ancestor, node and steps (the fewest) of all pairs that a path of edges (src, dst) joins; a node reaches itself over a cycle.

    Edges that repeat and those of a null end change nothing. A round extends the pairs that the round before has found,
    and keeps those that are new, so that it ends on cycles too. Every round is written to the shared folder. The result
    has as many rows as there are pairs, which for long chains is the square of their length.
    """
    known = materialize(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    every = fresh = materialize(known.select(F.col("src").alias("ancestor"), F.col("dst").alias("node"), F.lit(1).alias("steps")), "pairs")
    steps = 1
    while not fresh.isEmpty():
        steps += 1
        longer = fresh.join(known, F.col("node") == F.col("src")).select("ancestor", F.col("dst").alias("node")).distinct()
        fresh = materialize(longer.join(every, ["ancestor", "node"], "left_anti").withColumn("steps", F.lit(steps)), "pairs")
        every = every.union(fresh)
    return every


def lineage(edges: DataFrame) -> DataFrame:
    """ancestor, node, steps (the fewest), longest and cyclic of all pairs that a path joins.

    longest is null where a path between the two meets a cycle, and could be of any length; cyclic pairs are of nodes
    that reach each other. Otherwise see reach.
    """
    pairs = materialize(reach(edges), "reach")
    looped = materialize(pairs.filter("ancestor = node").select(F.col("node").alias("loop")), "loops")
    free = materialize(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().join(looped, F.col("src") == F.col("loop"), "left_anti").join(looped, F.col("dst") == F.col("loop"), "left_anti"), "free")
    # In the graph without the nodes of cycles paths end: a round finds the pairs that some path of its length joins.
    found = step = materialize(free.select(F.col("src").alias("ancestor"), F.col("dst").alias("node"), F.lit(1).alias("longest")), "paths")
    steps = 1
    while not step.isEmpty():
        steps += 1
        step = materialize(step.join(free, F.col("node") == F.col("src")).select("ancestor", F.col("dst").alias("node"), F.lit(steps).alias("longest")).distinct(), "paths")
        found = found.union(step)
    longest = found.groupBy("ancestor", "node").agg(F.max("longest").alias("longest"))
    # A path meets a cycle if its ends are on one, or a node of one lies between them.
    to = pairs.join(looped, F.col("node") == F.col("loop"), "left_semi").select("ancestor", F.col("node").alias("loop"))
    off = pairs.join(looped, F.col("ancestor") == F.col("loop"), "left_semi").select(F.col("ancestor").alias("loop"), "node")
    met = to.join(off, "loop").select("ancestor", "node").union(pairs.join(looped, F.col("ancestor") == F.col("loop"), "left_semi").select("ancestor", "node")).union(to.select("ancestor", F.col("loop").alias("node"))).distinct()
    back = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("node"), F.lit(True).alias("cyclic"))
    joined = pairs.join(longest, ["ancestor", "node"], "left").join(met.withColumn("met", F.lit(True)), ["ancestor", "node"], "left").join(back, ["ancestor", "node"], "left")
    return joined.select("ancestor", "node", "steps", F.when(F.col("met").isNull(), F.col("longest")).alias("longest"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
