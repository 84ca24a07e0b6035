"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint of 64 bits is seen as two halves of 31 bits (two bits are left over). Of two fingerprints that differ in
at most 3 bits, some half differs in at most 1. The anchors of a half are the words of the Hamming code of length 31,
a perfect covering code of radius 1: every half has an anchor within 1, so it suffices to replicate a fingerprint to all
anchors within radius + 1 = 2 of its half (at most 16) and to compare the fingerprints of each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import documents, free_names, materialize, sifted, text_keys

HALF = 31
SHINGLE = 3
SEED = 42
#: Anchors with more fingerprints than this are compared in tiles of about this size.
TILE = 2048


def fingerprint(text: str | None) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; zero without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    n = max(1, len(w) - SHINGLE + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 if set in over half of them."""
    n = len(hashes)
    rows = hashes.byteswap().view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(rows[i : i + 16384], axis=1).sum(0, dtype=np.int64) for i in range(0, n, 16384))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with fp, the fingerprint's 64 bits as a long."""
    (given,) = free_names([*keep, "fp"], "text")
    narrow = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias(given))
    schema = narrow.drop(given).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, (x.as_py() for x in batch.column(given))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return narrow.mapInArrow(run, schema)


def anchors(fp: Column) -> Column:
    """The anchors (longs) within 2 of either half of a fingerprint."""
    masks = [sum(1 << i for i in range(HALF) if (i + 1) >> b & 1) for b in range(5)]

    def of_half(half: Column, number: int) -> Column:
        syndrome = sum(((F.bit_count(half.bitwiseAND(F.lit(m))) % 2) * (1 << b) for b, m in enumerate(masks)), F.lit(0)).cast("int")

        def near(x: Column) -> Column:
            h, s = x["h"], x["s"]
            first = F.array(F.when(s == 0, h).otherwise(h.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), s - 1))))
            pairs = F.filter(F.sequence(F.lit(1), F.lit(HALF)), lambda i: (s != 0) & (i.bitwiseXOR(s) > i))
            second = F.transform(pairs, lambda i: h.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseXOR(s) - 1)))
            return F.transform(F.concat(first, second), lambda c: c + F.lit(number << HALF))

        return F.element_at(F.transform(F.array(F.struct(half.alias("h"), syndrome.alias("s"))), near), 1)

    low = fp.bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned(fp, HALF).bitwiseAND(F.lit((1 << HALF) - 1))
    return F.concat(of_half(low, 0), of_half(high, 1))


def near_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """src and dst: links that join all distinct fingerprints of the column fp as those within `distance` (at most 3) do.

    A greater distance, for which the anchors would miss links, is an error. Of the many links within an anchor's crowd only a spanning forest is returned, which keeps every connection.
    """
    if distance > 3:
        raise ValueError("anchors find links of 3 differing bits and fewer")
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # An explicit number of partitions, which Spark does not coalesce: the rows are few and small, but each becomes 28.
    placed = materialize(fps.repartition(parts, "fp").select("fp", F.explode(anchors(F.col("fp"))).alias("anchor")), "anchors")
    crowded = materialize(placed.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > TILE), "crowded")
    if crowded.isEmpty():
        tiled = placed.select("anchor", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    else:
        tiles = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
        spread = placed.join(crowded, "anchor", "left").select("anchor", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        tiled = spread.select("anchor", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = tiled.repartition(parts, "anchor", "a", "b").sortWithinPartitions("anchor", "a", "b")
    return dealt.mapInArrow(_comparer(distance), "src long, dst long").distinct()


def _comparer(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            starts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            last = starts[-1] if len(starts) else 0
            rest = rows[:, last:]
            if last:
                yield from _links(rows[3, :last], np.concatenate([[0], starts]), distance)
        if rest is not None and rest.shape[1]:
            yield from _links(rest[3], np.array([0, rest.shape[1]]), distance)

    return run


def _links(fp: np.ndarray, starts: np.ndarray, distance: int, small: int = 32) -> Iterator[pa.RecordBatch]:
    """Links within the groups that begin at `starts` (the last entry is the end)."""
    sizes = np.diff(starts)
    found = []
    group = np.repeat(np.arange(len(sizes)), sizes)
    crowd = sizes[group]
    pick = (crowd > 1) & (crowd <= small)
    few, of = fp[pick], group[pick]
    for k in range(1, small):
        i = np.flatnonzero(of[k:] == of[:-k]) if len(of) > k else np.empty(0, int)
        if not len(i):
            break
        i = i[np.bitwise_count(few[i] ^ few[i + k]) <= distance]
        found.append((few[i], few[i + k]))
    for g in np.flatnonzero(sizes > small):
        found.append(_forest(np.unique(fp[starts[g] : starts[g + 1]]), distance))
    for src, dst in found:
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])


def _forest(fp: np.ndarray, distance: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: breadth first, a block of the frontier against all not yet reached."""
    src, dst, left = [], [], np.arange(len(fp))
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            head, frontier = frontier[:block], frontier[block:]
            near = np.bitwise_count(fp[head][:, None] ^ fp[left][None, :]) <= distance
            hit = near.any(axis=0)
            if hit.any():
                src.append(fp[head[near[:, hit].argmax(axis=0)]])
                dst.append(fp[left[hit]])
                frontier, left = np.concatenate([frontier, left[hit]]), left[~hit]
    none = np.empty(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def _roots(held: DataFrame) -> DataFrame:
    """fp and root (the same for all of a component) of every fingerprint that has links."""
    return connected_components(near_links(held.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp and component_id (the smallest id reachable) of every row of docs.

    A null or empty text has fingerprint zero and is linked like any other. Rows that repeat an id or a text stay rows.
    Null ids are no candidates for component_id, which is null only where a component has no other id.
    """
    held = materialize(with_fingerprint(docs, [id_column], text), "fingerprints")
    by_fp = held.groupBy("fp").agg(F.min(id_column).alias("first"))
    joined = by_fp.join(_roots(held), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(joined.select("fp", "root", "first"), "roots")
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return held.join(named.join(firsts, "root").select("fp", "component_id"), "fp").select(F.col(f"`{id_column}`"), "fp", "component_id")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: see first_rows."""
    k1, k2 = text_keys(F.col(f"`{text}`"))
    keyed = docs.select(F.col(f"`{id_column}`").alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").alias("text"))
    held = materialize(with_fingerprint(keyed, ["id", "k1", "k2"]), "fingerprints")
    rows = held.join(_roots(held), "fp", "left").select("id", "k1", "k2", F.coalesce("root", "fp").alias("root"))
    return first_rows(docs, rows, id_column, text)


def first_rows(docs: DataFrame, rows: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each root of rows (id, k1, k2, root: a row for each of docs, with its text_keys).

    It is the one of the smallest id, null ids last, and of the smallest text keys among rows of that id. Of rows that
    repeat both, which may differ in other columns, the one whose JSON is the least stays, so columns may be of any type
    that JSON can tell, maps included. Columns keep their names, whatever they are. Most rows stay for certain, since a
    bitmap of those that may go (or repeat) does not have them; only the others are joined, so most texts are not shuffled.
    """
    of_id, of_k1, of_k2, many, row, key, met = free_names(docs.columns, "id", "k1", "k2", "n", "row", "key", "met")
    once = rows.groupBy("root", "id", "k1", "k2").agg(F.count("*").alias("n"))
    least = once.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "n")).alias("x"))
    chosen = materialize(least.select(F.col("x.id").alias(of_id), F.col("x.k1").alias(of_k1), F.col("x.k2").alias(of_k2), F.col("x.n").alias(many)), "chosen")
    k1, k2 = text_keys(F.col(f"`{text}`"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = chosen.filter(F.col(many) == 1)
    others = once.join(alone, F.col("id").eqNullSafe(F.col(of_id)) & (F.col("k1") == F.col(of_k1)) & (F.col("k2") == F.col(of_k2)), "left_anti")
    marked = sifted(docs.withColumn(key, F.xxhash64(f"`{id_column}`", k1, k2)), key, materialize(others.select(F.xxhash64("id", "k1", "k2").alias(key)), "others"), met)
    stays, docs = marked.filter(~F.col(met)).select(*columns), marked.filter(met).select(*columns)
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(of_id)) & (k1 == F.col(of_k1)) & (k2 == F.col(of_k2))
    single = stays.union(docs.join(alone, same).select(*columns))
    repeated = chosen.filter(F.col(many) > 1)
    if repeated.isEmpty():
        return single
    least = docs.join(repeated, same).groupBy(of_id, of_k1, of_k2).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(row))
    return single.union(least.select(*[F.col(f"{row}.`{c}`") for c in docs.columns]))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of all documents."""
    found = components(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
