"""Mixing sources to target weights by pivotal dependent rounding of fractional copy numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import documents, free_names, materialize, words

#: Weights of the sources in their order, repeating; what they share, in parts of all sizes; the most copies of one document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: How many documents a leaf of the reduction tree rounds, about, and how many residuals an inner node combines.
FAN_IN = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n and target from rows of (source, source_size, n), one row for each source.

    Each source is due its weight's part of share * all sizes, stops at most * its size, and what is over goes to the
    others by weight until none is above. Each round is one sum over the sources, which may be as many as there are
    websites: they are numbered by ranges, and no task sees all of them.
    """
    ranked = _numbered(sizes).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", most * F.col("source_size"))
    everything = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.col("stop") < level * F.col("weight")
        row = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("stop"))).alias("stop"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if row.n == stopped or row.weight is None:
            break
        level, stopped = (everything - (row.stop or 0.0)) / row.weight, row.n
    # Sources that stop have a level above theirs, which only rises from round to round; if all stop, each gets its stop.
    target = F.least(F.col("stop"), F.when(F.lit(row.weight is None), F.col("stop")).otherwise(F.lit(level) * F.col("weight")))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with number: its place by code points of the source, from 0 on, null last."""
    order = (F.col("source").isNull(), F.col("source"))
    dealt = materialize(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    counted = dealt.groupBy("part").agg(F.count("*").alias("many"))  # at most as many rows as Spark has shuffle partitions
    starts = counted.select("part", (F.sum("many").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("many")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(starts), "part").withColumn("number", F.col("before") + F.col("own")).drop("part", "own", "before")


def _chance(*columns: Column) -> Column:
    """A number in [0, 1) that hangs on nothing but the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _fold(items: Column, kind: str) -> Column:
    """Rounds an array of structs (p, mass, id, size) in turn, largest first so that a small one is left; struct(done: array of (id, size, up), p, mass, id, size of the residual).

    The held document and the next one trade chances so that p * mass of both together stays the same, in a random
    direction that leaves either chance as it was, until one of the two is 0 or 1.
    """

    def step(s: Column, x: Column) -> Column:
        gain = F.least((1 - s["p"]) * s["mass"], x["p"] * x["mass"])
        loss = F.least(s["p"] * s["mass"], (1 - x["p"]) * x["mass"])

        def trade(t: Column) -> Column:
            gain, loss, up = t["gain"], t["loss"], t["up"]
            p = F.when(up, s["p"] + gain / s["mass"]).otherwise(s["p"] - loss / s["mass"])
            q = F.when(up, x["p"] - gain / x["mass"]).otherwise(x["p"] + loss / x["mass"])
            held_done = F.when(up, gain >= (1 - s["p"]) * s["mass"]).otherwise(loss >= s["p"] * s["mass"])
            decided = lambda one, way: F.struct(one["id"].alias("id"), one["size"].alias("size"), way.cast("int").alias("up"))
            left = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(held_done, q).otherwise(p)))
            other = [F.when(held_done, x[c]).otherwise(s[c]).alias(c) for c in ("mass", "id", "size")]
            return F.struct(F.array_append(s["done"], F.when(held_done, decided(s, up)).otherwise(decided(x, ~up))).alias("done"), left.alias("p"), *other)

        up = _chance(s["id"], s["size"], x["id"], x["size"], F.lit("trade")) * (gain + loss) < loss
        return F.element_at(F.transform(F.array(F.struct(gain.alias("gain"), loss.alias("loss"), up.alias("up"))), trade), 1)

    first = F.element_at(items, 1)
    none = F.array().cast(f"array<struct<id:{kind},size:bigint,up:int>>")
    start = F.struct(none.alias("done"), *[first[c].alias(c) for c in ("p", "mass", "id", "size")])
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies (long) of every row of docs.

    Each document is due target / source_size copies; the whole part is given to all, and the rest is rounded up or down
    by pivotal rounding over a tree of groups: leaves by hash, then FAN_IN residuals a node, then one draw for each
    source. So a source's words differ from its target by less than one document's size, up to rounding of doubles.
    Rows alike in id, source and size share one decision, as one item of their joint size, which the difference may then
    reach. A null text or one without words has size 0 and no copies; null is a source of its own; other columns are not
    looked at; an empty table gives an empty result. Reruns agree: chances are hashes of ids and sizes. Decisions go back
    to the documents by id, source and size themselves; a hash only deals them to leaves.
    """
    sized = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source}`").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"))
    kind = sized.schema["id"].dataType.simpleString()
    base = materialize(sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    totals = base.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    aims = materialize(targets(totals), "targets")
    due = base.alias("b").join(aims.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "id", "b.source", "size", "rows", "source_size", "target", "n", (F.col("target") / F.greatest("source_size", F.lit(1))).alias("ratio")
    )
    due = materialize(due.withColumn("whole", F.floor(F.col("ratio") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole"))), "due")
    leaves = F.ceil(F.col("n") / FAN_IN).cast("long")
    level = due.filter((F.col("size") > 0) & (F.col("p") > 1e-12)).select(
        "source", F.pmod(F.xxhash64("id", "size"), leaves).alias("node"), "p", (F.col("size") * F.col("rows")).cast("double").alias("mass"), "id", "size"
    )
    nodes = (aims.agg(F.max("n")).first()[0] or 0) // FAN_IN + 1
    decided = []
    while True:
        gathered = level.groupBy("source", "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("mass")).alias("order"), "id", "size", "p", "mass"))).alias("items"))
        folded = materialize(gathered.select("source", "node", _fold(F.col("items"), kind).alias("s")), "rounded")
        decided.append(folded.select("source", F.explode("s.done").alias("d")).select("source", "d.id", "d.size", "d.up"))
        if nodes == 1:
            decided.append(folded.select("source", "s.id", "s.size", (_chance(F.col("s.id"), F.col("s.size"), F.lit("last")) < F.col("s.p")).cast("int").alias("up")))
            break
        level = folded.select("source", F.floor(F.col("node") / FAN_IN).alias("node"), "s.p", "s.mass", "s.id", "s.size")
        nodes = (nodes - 1) // FAN_IN + 1
    ups = decided[0]
    for more in decided[1:]:
        ups = ups.union(more)
    same = F.col("d.id").eqNullSafe(F.col("u.id")) & F.col("d.source").eqNullSafe(F.col("u.source")) & (F.col("d.size") == F.col("u.size"))
    chosen = due.alias("d").join(ups.alias("u"), same, "left").select("d.*", "u.up")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("up", F.lit(0))).otherwise(0).cast("long")
    each = chosen.select("id", "source", "size", "source_size", "target", copies.alias("copies"), F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select(F.col("id").alias(id_column), F.col("source").alias(source), "size", "source_size", "target", "copies")


def repeat_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with every row as often as the mix takes it, in docs' columns, whatever their names; see mix."""
    of_id, of_source, of_size, times, n, each = free_names(docs.columns, "id", "source", "size", "copies", "n", "each")
    mixed = mix(docs.select(id_column, text, source), id_column, text, source)
    taken = mixed.filter("copies > 0").select(F.col(f"`{id_column}`").alias(of_id), F.col(f"`{source}`").alias(of_source), F.col("size").alias(of_size), F.col("copies").cast("int").alias(times)).distinct()
    sized = docs.withColumn(n, F.size(words(F.col(f"`{text}`"))).cast("long"))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(of_id)) & F.col(f"`{source}`").eqNullSafe(F.col(of_source)) & (F.col(n) == F.col(of_size))
    given = [F.col(f"`{c}`") for c in docs.columns]
    return sized.join(taken, same).select(*given, F.explode(F.sequence(F.lit(1), F.col(times))).alias(each)).select(*given)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and copies of all documents."""
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
