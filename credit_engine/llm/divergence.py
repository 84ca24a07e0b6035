"""Which sources of a language differ in their words, and by which: a sorted stream of terms, scanned run by run.

Documents become rows (lang, term, source, document, docs, count), summed up over blocks of documents before the shuffle.
They are dealt by (lang, term) and sorted by (lang, term, source, document), so that one scan that holds a single run sees
every term's document frequency and its counts by source. The runs of kept terms are then streamed behind their language's
totals, and give partial sums of differences for pairs of sources and the best terms of each source. Integers are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import documents, materialize

#: Documents that a kept term needs, occurrences added to each count, what probabilities are multiplied by, terms told of each source.
LEAST, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Sums that a worker holds before it hands them on; sources whose pairs are summed up together; kept terms of one stream.
HELD, TILE, TERMS = 400_000, 512, 20_000
#: What no term holds becomes a space, A-Z lower case; bytes of other characters are over 127 and stay.
_TERMS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8: runs of letters A-Z, in lower case, and of characters beyond ASCII."""
    return (text or "").encode().translate(_TERMS).split()


def _count(kind: str):
    """Rows of (lang, source, document, text) to sums over blocks of documents; an empty term counts the documents."""
    names = ["lang", "term", "source", "document", "docs", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[str, str], tuple[object, Counter, Counter]] = {}  # by group: first document, docs, counts
        held, document_type = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (first, docs, counts) in blocks.items():
                found = list(docs)
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    n = len(part)
                    same = [pa.repeat(pa.scalar(x, t), n) for x, t in ((lang, pa.string()), (source, pa.string()), (first, document_type))]
                    sums = [pa.array([of[t] for t in part], pa.int64()) for of in (docs, counts)]
                    yield pa.RecordBatch.from_arrays([same[0], pa.array(part, pa.string()), *same[1:], *sums], names=names)
            blocks.clear()

        for batch in batches:
            document_type = batch.schema.field(2).type
            for lang, source, document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                _, docs, counts = blocks.setdefault((lang, source), (document.as_py(), Counter(), Counter()))
                found, before = terms(text.as_py()), len(docs)
                counts.update(found)
                docs.update(set(found))
                docs[b""] += 1
                held += len(docs) - before
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return run, f"lang string, term string, source string, document {kind}, docs long, count long"


_RUN = "lang string, term string, sources array<string>, counts array<long>"


def _scan(least: int):
    """Sorted rows of (lang, term, source, document, docs, count) to the runs of kept terms; runs of the empty term are all kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_docs, open_counts = None, 0, {}  # the run that may go on in the next batch

        def kept(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "term", "sources", "counts"])

        def closed() -> list[tuple]:
            return [(*open_key, list(open_counts), list(open_counts.values()))] if open_key and (open_docs >= least or not open_key[1]) else []

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, source = (batch.column(i) for i in range(3))
            docs, counts = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            changed = pc.or_(*[pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)) for c in (lang, term)]).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            total, rows, ends = np.add.reduceat(docs, starts), [], np.append(starts[1:], batch.num_rows)
            told = (total >= least) | pc.equal(term, "").to_numpy(zero_copy_only=False)[starts]
            told[[0, -1]] = True
            for i in np.flatnonzero(told).tolist():
                lo, hi = int(starts[i]), int(ends[i])
                key = (lang[lo].as_py(), term[lo].as_py())
                if key != open_key:
                    rows += closed()
                    open_key, open_docs, open_counts = key, 0, {}
                open_docs += int(total[i])
                for s, n in zip(source.slice(lo, hi - lo).to_pylist(), counts[lo:hi].tolist(), strict=True):
                    open_counts[s] = open_counts.get(s, 0) + n
            yield kept(rows)
        yield kept(closed())

    return run


def _share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + ADDED) / total), exactly; totals broadcast."""
    if counts.size and int(counts.max()) + ADDED > (1 << 63) // SCALE - 1:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + ADDED) // total).astype(np.int64)


_PARTIAL = "lang string, source string, part string, item string, value long"


def _differ(top: int, tile: int):
    """Streams of a language's head (kind 0: all its sources with their totals) and runs to partial sums of pairs and best terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None

        def done() -> Iterator[pa.RecordBatch]:
            lang, a, b, names, _, _, sums, best = of
            left, right = names[a * tile : (a + 1) * tile], names[b * tile : (b + 1) * tile]
            for i, source in enumerate(left):
                j = i + 1 if a == b else 0
                found = [("pair", item, value) for item, value in zip(right[j:], sums[i, j:].tolist(), strict=True)] + [("term", term, -minus) for minus, term in (best[i] if a == b else ())]
                if found:
                    parts, items, values = zip(*found, strict=True)
                    n = len(found)
                    columns = [pa.repeat(lang, n), pa.repeat(source, n), pa.array(parts), pa.array(items, pa.string()), pa.array(values, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

        def add(rows: pa.RecordBatch) -> None:
            _, a, b, names, totals, v, sums, best = of
            lists = rows.column("sources")
            place = pc.index_in(lists.flatten(), value_set=pa.array(names, pa.string())).to_numpy()
            row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
            n = rows.column("counts").flatten().to_numpy()
            shares, mine = {}, {}
            for x in {a, b}:
                inside = place // tile == x
                mine[x] = np.zeros((rows.num_rows, len(names[x * tile : (x + 1) * tile])), np.int64)
                mine[x][row[inside], place[inside] % tile] = n[inside]
                shares[x] = _share(mine[x], totals[x * tile : (x + 1) * tile] + ADDED * v)
            for i in range(shares[a].shape[1]):
                sums[i] += np.abs(shares[b] - shares[a][:, i : i + 1]).sum(axis=0)
            if a != b:
                return
            every = np.zeros(rows.num_rows, np.int64)
            np.add.at(every, row, n)
            over = shares[a] - _share(every, int(totals.sum()) + ADDED * v)[:, None]
            names_of_terms = rows.column("term").to_pylist()
            for i in range(over.shape[1]):
                at = np.flatnonzero((mine[a][:, i] > 0) & (over[:, i] > 0))
                if len(at) > top:  # with all that tie with the last one
                    at = at[over[at, i] >= np.partition(over[at, i], -top)[-top]]
                best[i] = sorted(best[i] + [(-int(over[t, i]), names_of_terms[t]) for t in at.tolist()])[:top]

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "a", "b", "salt", "kind")]
            changed = np.any([k[1:] != k[:-1] for k in keys], axis=0) if batch.num_rows else np.empty(0, bool)
            for lo, hi in pairwise([0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]):
                if hi == lo:
                    continue
                if keys[4][lo] == 0:
                    if of is not None:
                        yield from done()
                    names, totals = batch.column("sources")[lo].as_py(), np.array(batch.column("counts")[lo].as_py(), np.int64)
                    a, b = int(keys[1][lo]), int(keys[2][lo])
                    width = [len(names[x * tile : (x + 1) * tile]) for x in (a, b)]
                    of = (keys[0][lo], a, b, names, totals, int(batch.column("v")[lo].as_py()), np.zeros(width, np.int64), [[] for _ in range(width[0])])
                    continue
                for at in range(lo, hi, 1000):
                    add(batch.slice(at, min(1000, hi - at)))
        if of is not None:
            yield from done()

    return run


def divergence(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source's words are from each other source's and from its language's.

    Terms that at least `least` documents of a language hold are kept there. With V kept terms, a group (a source, or the
    whole language) in which they occur N times, and a term that occurs n times in it, the term's share is
    p = 1 + floor(SCALE * (n + ADDED) / (N + ADDED * V)). Part `pair`: the sum over kept terms of |p - q| for each other
    source of the language. Part `term`: p - q for the terms of the source that are more common in it than in the
    language, the `top` greatest. Ranks go by value, then by the item's UTF-8.

    Null texts, languages and sources are empty strings. Rows are documents, even if they repeat an id or have none; other
    columns are not looked at. A language of one source has no pairs, one without kept terms has pairs of 0, and an empty
    table gives an empty result. The result has a row for each pair of sources of a language, so a language's list of
    sources is held whole; sums of pairs are held by tiles of it.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    narrow = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), F.col(f"`{id_column}`").alias("document"), empty(text).alias("text"))
    count, shape = _count(narrow.schema["document"].dataType.simpleString())
    dealt = narrow.mapInArrow(count, shape).repartition(parts, "lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    runs = materialize(dealt.mapInArrow(_scan(least), _RUN), "runs")

    kept = runs.filter("term <> ''")
    sums = kept.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = runs.filter("term = ''").select("lang", F.explode("sources").alias("source"))
    totals = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    tiles = F.ceil(F.size("x") / F.lit(TILE)).cast("int")
    held = totals.join(sizes, "lang", "left").select("lang", F.col("x.source").alias("sources"), F.col("x.n").alias("counts"), F.coalesce("v", F.lit(0)).alias("v"), tiles.alias("tiles"))
    heads = materialize(held, "heads")
    salts = 1 + (heads.agg(F.max("v")).first()[0] or 0) // TERMS

    def placed(rows: DataFrame, salt, kind: int) -> DataFrame:
        """Rows for every pair of tiles a <= b."""
        each = rows.select("*", salt, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("a")).select("*", F.explode(F.sequence("a", F.col("tiles") - 1)).alias("b"))
        return each.select("lang", "a", "b", "salt", F.lit(kind).alias("kind"), "v", "term", "sources", "counts")

    first = placed(heads.withColumn("term", F.lit("")), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), 0)
    rest = placed(kept.join(heads.select("lang", "v", "tiles"), "lang"), F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"), 1)
    order = ("lang", "a", "b", "salt", "kind")
    streams = first.unionByName(rest).repartition(parts, *order[:4]).sortWithinPartitions(*order)
    partial = materialize(streams.mapInArrow(_differ(top, TILE), _PARTIAL), "differences")

    half = partial.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = half.select("lang", F.lit("pair").alias("part"), "value", F.explode(both).alias("x")).select("lang", "x.source", "part", "x.item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [df.select("lang", "source", "part", "item", "value", rank.alias("rank")) for df in (pairs, partial.filter("part = 'term'"))]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value and rank over all documents; see divergence."""
    return divergence(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN kept ON kept.lang = l.lang GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (
  SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS BIGINT) AS p
  FROM n JOIN v ON v.lang = n.lang JOIN kept ON kept.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
q AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (any_value(everything) + 5 * any_value(v)) AS BIGINT) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS everything FROM n GROUP BY 1) USING (lang) GROUP BY 1, 2),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
