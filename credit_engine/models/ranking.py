"""Personalised rank on a weighted graph: where a mass that starts at some nodes comes to rest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import delete, materialize, new_path

#: Blocks that nodes are dealt to; an edge lies in the cell of its two ends' blocks, so that those of one node are in as many cells.
SIDE = 8
#: Whether Spark shuffles both sides of a join that lie together by some of its keys.
COPARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def _block(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SIDE)).cast("int")


def _handed(ranks: DataFrame, weights: DataFrame) -> DataFrame:
    """node and got, what the edges hand on of ranks (node, total, rank).

    The weights are bucketed by cell and stay where they are. A node's rank goes to its SIDE cells, and what a cell has for
    a node is summed up there, so that the rows of a round grow with the nodes and not with the edges.
    """
    given = ranks.filter("total IS NOT NULL AND rank > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("total")).alias("part"), _block("node").alias("__from"), F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("__to"))
    dealt = given.select((F.col("__from") * SIDE + F.col("__to")).alias("cell"), "src", "part").repartition(SIDE * SIDE, "cell")
    return dealt.hint("shuffle_hash").join(weights, ["cell", "src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("part") * F.col("weight")).alias("got"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-9, hub: int | None = None) -> DataFrame:
    """node and rank of every node of edges (src, dst, weight) and seeds (node, mass).

    In each round a node hands `damping` of its rank on along its edges, in proportion to their weights; the rest, and all
    that nodes without edges have, goes back to the seeds in proportion to their mass. Ranks add up to one. It ends when
    no more than `tolerance` moves, or after `rounds`. Edges that repeat add up; those of a null end or without a positive
    weight count for nothing, as do seeds without a positive mass. Without seeds all ranks are null.

    The edges are dealt to cells once, see _handed; those of one node, however many, are in SIDE cells, so that `hub`, which
    callers may still give, changes nothing. Every round is
    written to the shared folder, so that plans do not grow with the rounds; what reaches the driver is two sums.
    """
    spark = edges.sparkSession
    name, place = f"weights_{uuid.uuid4().hex}", new_path(spark, "weights")
    known = edges.filter((F.col("weight") > 0) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select((_block("src") * SIDE + _block("dst")).alias("cell"), "src", "dst", "weight")
    summed = known.repartition(SIDE * SIDE, "cell").groupBy("cell", "src", "dst").agg(F.sum("weight").alias("weight"))
    summed.write.bucketBy(SIDE * SIDE, "cell").option("path", place).saveAsTable(name)
    weights = spark.table(name)

    seeded = materialize(seeds.filter("node IS NOT NULL").groupBy("node").agg(F.sum(F.when(F.col("mass") > 0, F.col("mass"))).alias("mass")), "seeds")
    whole = seeded.agg(F.sum("mass")).first()[0]
    nothing = F.lit(None).cast("double")
    every = weights.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("total")).select("node", nothing.alias("mass"), "total")
    every = every.unionByName(weights.groupBy(F.col("dst").alias("node")).agg(nothing.alias("mass"), nothing.alias("total"))).unionByName(seeded.select("node", F.col("mass").cast("double"), nothing.alias("total")))
    begun = every.groupBy("node").agg(F.max("mass").alias("mass"), F.max("total").alias("total"))
    nodes = materialize(begun.select("node", (F.coalesce("mass", F.lit(0.0)) / F.lit(whole)).alias("seed"), "total"), "nodes")

    ranks, path = nodes.select("node", "seed", "total", F.col("seed").alias("rank")), None
    held_conf = spark.conf.get(COPARTITION)
    spark.conf.set(COPARTITION, "false")  # cells join by (cell, src) as they lie
    for _ in range(0 if whole is None else rounds):
        loose = ranks.filter("total IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        back = (1.0 - damping) + damping * loose
        rank = damping * F.coalesce("got", F.lit(0.0)) + back * F.col("seed")
        moved = ranks.join(_handed(ranks, weights), "node", "left").select("node", "seed", "total", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved"))
        fresh = new_path(spark, "ranks")
        moved.write.parquet(fresh)
        if path:
            delete(spark, path)
        held = spark.read.schema(moved.schema).parquet(fresh)
        ranks, path = held.drop("moved"), fresh
        if held.agg(F.coalesce(F.sum("moved"), F.lit(0.0))).first()[0] <= tolerance:
            break
    spark.conf.set(COPARTITION, held_conf)
    spark.sql(f"DROP TABLE {name}")
    delete(spark, place)
    return ranks.select("node", F.when(F.lit(whole is not None), F.col("rank")).alias("rank"))
