"""Chat formatting with cumulative-snapshot collapse: a logged conversation that begins a longer one is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize


def _turn_hash(seed: str) -> Column:
    """A hash of a turn at its place; null differs from empty."""
    parts = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return F.xxhash64(F.lit(seed), F.col("place"), *parts)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, n_turns and the rolling hashes h1 and h2 of the turns up to each place.

    A turn of null conv_id is a conversation by itself, so that very many of these are no group.
    """
    own = W.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    alone = turns.filter("conv_id IS NULL").withColumn("place", F.lit(1)).select("conv_id", "place", F.lit(1).cast("long").alias("n_turns"), _turn_hash("first").alias("h1"), _turn_hash("second").alias("h2"))
    placed = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("place"))
    hashed = placed.select("conv_id", "turn", "role", "text", "place", _turn_hash("first").alias("a"), _turn_hash("second").alias("b"))
    rolled = hashed.select("conv_id", "place", F.count("*").over(own).alias("n_turns"), F.bit_xor("a").over(upto).alias("h1"), F.bit_xor("b").over(upto).alias("h2"))
    return rolled.unionByName(alone)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, h1 and h2 of the conversations that are no beginning of a longer one; of equal ones the smallest conv_id."""
    rolled = materialize(prefixes(turns), "prefixes")
    whole = rolled.filter("place = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    longer = rolled.filter("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(longer, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "copies", "h1", "h2")


def _line(role: Column, text: Column) -> Column:
    """A turn as <|im_start|>role, a line break, the text, <|im_end|> and a line break; null prints as empty."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id and chat: the lines of a conversation's turns in their order."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: _line(x["role"], x["text"])), "").alias("chat"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and chat of the maximal conversations of turns (conv_id, turn, role, text; others are ignored).

    Turns are ordered by turn, then role and text, so repeated rows are turns said twice. Rows of null conv_id are
    conversations of one turn each. An empty table gives an empty result. Prefixes meet as two 64-bit hashes with their length; only these are compared, never all pairs.
    """
    kept = materialize(maximal(turns), "maximal")
    said = turns.select("conv_id", "turn", "role", "text")
    chats = render(said.join(kept.select("conv_id"), "conv_id", "left_semi"))
    alone = said.filter("conv_id IS NULL").withColumn("place", F.lit(1)).groupBy(_turn_hash("first").alias("h1"), _turn_hash("second").alias("h2")).agg(F.min(_line(F.col("role"), F.col("text"))).alias("chat"))
    result = ["conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies", "chat"]
    return kept.join(chats, "conv_id").select(*result).unionByName(kept.filter("conv_id IS NULL").join(alone, ["h1", "h2"]).select(*result))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, copies and chat of all maximal conversations."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = """
WITH said AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
conv AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'r': role, 't': text} ORDER BY turn, role, text) AS said,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM said GROUP BY conv_id, alone),
whole AS (SELECT said, min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS copies, min(chat) AS chat FROM conv GROUP BY said),
cut AS (
  SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM conv))
SELECT conv_id, n_turns, copies, chat FROM whole
WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.said = whole.said)
"""
