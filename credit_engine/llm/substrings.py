"""Substring deduplication by a log-structured index of window fingerprints.

A window's fingerprint is the least hash of the 8-word grams in it, so equal windows share it, and neighbouring windows
mostly do as well: a document has one entry for about 14 windows. Each batch of documents makes an immutable run of
entries (fp, k1), sorted and bucketed by fingerprint, which is merge-joined with the runs before it. Windows whose
fingerprint occurs twice or more, in the batch or in a run, are then verified by their words. What the words cover is
added to what earlier batches left covered, of older documents too. Entries that tell nothing new, since another
document holds the same windows, are left out of the run, and runs of one level are compacted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, documents, exists, free_names, materialize, new_path, scratch, sifted, text_keys, words

WINDOW, GRAM = 35, 8
#: Documents of one fingerprint that are verified together; those of more common ones are salted by this.
TOGETHER = 4096
#: Words of a group up to which its windows are told apart by a dictionary.
MANY = 200_000
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` neighbours."""
    up, down = _powers(1 << max(12, int(len(hashes)).bit_length()))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    x = (total[size:] - total[:-size]) * down[: len(hashes) - size + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, span: int, choose) -> np.ndarray:
    """The least or greatest of every `span` neighbours, by doubling."""
    width = 1
    while 2 * width <= span:
        x, width = choose(x[:-width], x[width:]), 2 * width
    return choose(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def window_fingerprints(w: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: the hashes of the words, the fingerprint of every window, and the distinct fingerprints once for each place.

    Places, not windows, are counted: a gram that is the least of some window around it is one place.
    """
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    if len(w) < window:
        return hashes, np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams, span = _rolling(hashes, gram), window - gram + 1
    least = _sliding(grams, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    placed = grams[_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == grams]
    return hashes, least, placed


def _sketch(window: int):
    """Rows of (k1, k2, text) to one for each text and task: number of copies, words, packed words and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        copies: dict[tuple[int, int], int] = {}
        names = ["k1", "k2", "copies", "n_words", "packed", "places"]
        for batch in batches:
            rows = []
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (k1, k2) in copies:
                    copies[k1, k2] += 1
                    continue
                copies[k1, k2] = 0
                w = (text.as_py() or "").encode().split()
                places = window_fingerprints(w, window)[2].view(np.int64) if len(w) >= window else np.empty(0, np.int64)
                rows.append((k1, k2, 1, len(w), pack(b" ".join(w)), places))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _SKETCH_TYPES, strict=True)], names=names)
        more = [(*k, n) for k, n in copies.items() if n]
        for i in range(0, len(more), 10000):
            part = more[i : i + 10000]
            columns = [*zip(*part, strict=True), *[[None] * len(part)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SKETCH_TYPES, strict=True)], names=names)

    return run


_SKETCH_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
_SKETCH = "k1 long, k2 long, copies long, n_words int, packed binary, places array<long>"


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _candidates(window: int):
    """Rows of (k1, k2, copies, packed, fps, ns) to stretches of windows of one fingerprint, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            columns = [batch.column(n) for n in ("k1", "k2", "copies", "packed", "fps", "ns")]
            for k1, k2, copies, packed, fps, ns in zip(*columns, strict=True):
                w = unpack(packed.as_py()).split()
                _, least, _ = window_fingerprints(w, window)
                fps = fps.values.to_numpy().view(np.uint64)
                order = np.argsort(fps)
                fps, ns = fps[order], ns.values.to_numpy()[order]
                at = np.minimum(np.searchsorted(fps, least), len(fps) - 1)
                hit = fps[at] == least
                if not hit.any():
                    continue
                ends = np.flatnonzero(np.diff(at) | np.diff(hit)) + 1
                k1, k2, weight = k1.as_py(), k2.as_py(), min(2, copies.as_py())
                spans = [(lo, hi) for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(at)], strict=True) if hit[lo]]
                many = np.bincount(at[[lo for lo, _ in spans]]).tolist()
                for lo, hi in spans:
                    salts = -(-int(ns[at[lo]]) // TOGETHER)
                    out.append((int(fps[at[lo]].view(np.int64)), k1 % salts, salts, k1, k2, weight, lo, b" ".join(w[lo : hi - 1 + window]), many[at[lo]]))
            yield _batch(out, _STRETCH)

    return run


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    """Rows as Arrow, by the names and types of a schema in Spark's words."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, kinds = zip(*[x.split() for x in shape.split(", ")], strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


_STRETCH = "fp long, salt int, salts int, k1 long, k2 long, weight int, lo int, words binary, many int"
#: Words lo to hi of a text are covered; or, with a window's words, what other salts have to decide; or, with n = 0, one of
#: the text's lo stretches of the fingerprint tells nothing new.
_VERDICT = "fp long, words binary, n long, k1 long, k2 long, lo int, hi int"


def _same_words(lists: list[list[bytes]], row: np.ndarray, place: np.ndarray, first: np.ndarray, window: int) -> bool:
    """Whether every window (a row's place) has the words of the window numbered in `first`; stretches are compared at once."""
    apart = np.flatnonzero(first != np.arange(len(first)))
    if not len(apart):
        return True
    cuts = np.flatnonzero((np.diff(apart) != 1) | (np.diff(first[apart]) != 1) | (np.diff(row[apart]) != 0) | (np.diff(row[first[apart]]) != 0)) + 1
    for part in np.split(apart, cuts):
        a, b, more = part[0], first[part[0]], len(part) - 1 + window
        if lists[row[a]][place[a] : place[a] + more] != lists[row[b]][place[b] : place[b] + more]:
            return False
    return True


def _numbered(lists: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of lists of words: their list and place, a number that equal ones share, and the first of each number."""
    sizes = np.array([len(w) - window + 1 for w in lists])
    row, place = np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.arange(n) for n in sizes])
    digests = np.concatenate([_rolling(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), window) for w in lists])
    _, first, of = np.unique(digests, return_index=True, return_inverse=True)
    if not _same_words(lists, row, place, first[of], window):  # two texts of one hash: told apart by their words
        seen: dict[tuple, int] = {}
        of = np.array([seen.setdefault(tuple(lists[r][p : p + window]), len(seen)) for r, p in zip(row.tolist(), place.tolist(), strict=True)])
        first = np.unique(of, return_index=True)[1]
    return row, place, of, first


def _verify(window: int):
    """Stretches, sorted by fingerprint and salt, to verdicts."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        """Windows of a group are equal if their words are: few go by a dictionary of them, many by hashes that are then verified."""
        lists = [r[7].split() for r in rows]
        keys: list[list]
        if sum(map(len, lists)) <= MANY:
            keys = [[tuple(w[i : i + window]) for i in range(len(w) - window + 1)] for w in lists]
        else:
            row, _, of, _ = _numbered(lists, window)
            keys = [x.tolist() for x in np.split(of, np.flatnonzero(np.diff(row)) + 1)]
        total: dict = {}
        for r, mine in zip(rows, keys, strict=True):
            for key in mine:
                total[key] = total.get(key, 0) + r[5]
        led: set = set()
        for (fp, _, salts, k1, k2, weight, lo, _, many), w, mine in zip(rows, lists, keys, strict=True):
            fresh = [key for key in mine if key not in led]
            led.update(fresh)
            if not fresh:
                yield (fp, None, 0, k1, None, many, None)
            if salts > 1:
                for key in dict.fromkeys(fresh):
                    if total[key] > 1:
                        i = mine.index(key)
                        yield (fp, b" ".join(w[i : i + window]), 2, None, None, None, None)
            if weight > 1:
                continue
            start = None
            for i, key in enumerate([*mine, None]):
                twice = i < len(mine) and total[key] > 1
                if twice and start is None:
                    start = i
                elif not twice and start is not None:
                    yield (None, None, None, k1, k2, lo + start, lo + i - 1 + window)
                    start = None
                if salts > 1 and i < len(mine) and not twice:
                    yield (fp, b" ".join(w[i : i + window]), 1, k1, k2, lo + i, lo + i + window)

    def alone(rows: list[tuple]) -> bool:
        return len(rows) == 1 and rows[0][2] == 1 and rows[0][5] == 1 and rows[0][7].count(b" ") == window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for stretch in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:2] != stretch[:2]:
                    out += () if alone(held) else group(held)
                    held = []
                held.append(stretch)
            yield _batch(out, _VERDICT)
        if held and not alone(held):
            yield _batch(list(group(held)), _VERDICT)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (k1, k2, packed, los, his) to the words that stay."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        removed, kept = [], []
        for packed, los, his in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            w = np.array(unpack(packed.as_py()).split(), object)
            edges = np.zeros(len(w) + 1, np.int64)
            np.add.at(edges, los.values.to_numpy(), 1)
            np.add.at(edges, his.values.to_numpy(), -1)
            stays = np.cumsum(edges[:-1]) == 0
            removed.append(len(w) - int(stays.sum()))
            kept.append(b" ".join(w[stays]).decode())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["k1", "k2", "n_removed", "kept"])


class SubstringIndex:
    """What is known of all documents so far, as immutable tables in a folder; any session can go on with it.

    Kinds of tables: texts, copies (of texts known before) and cover by k1, runs by fp and salt. All are bucketed, so that
    they join without a shuffle of what is stored. A fingerprint of very many documents is dealt to several salts; there
    are at most four such for each bucket. A run holds no entry that tells nothing new, since another document holds the
    same windows. The list of tables is written as a new version after each batch, and what it no longer names is deleted
    only then: a batch that fails changes nothing.
    """

    KINDS = {  # noqa: RUF012
        "texts": (_SKETCH, ["k1"]), "copies": ("k1 long, k2 long, copies long", ["k1"]), "cover": ("k1 long, k2 long, lo int, hi int", ["k1"]),
        "runs": ("fp long, salt int, salts int, k1 long", ["fp", "salt"]),
    }

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW):
        self.spark, self.window, self.buckets = spark, window, _parts(spark)
        self.path = path or new_path(spark, "substrings")
        self.version, self.tables = 0, []  # of (kind, level, name, buckets)
        if exists(spark, f"{self.path}/state"):
            state = spark.read.parquet(f"{self.path}/state")
            self.version = state.agg(F.max("version")).first()[0]
            self.tables = sorted(tuple(r) for r in state.filter(F.col("version") == self.version).select("kind", "level", "name", "buckets").collect())

    def _write(self, df: DataFrame, kind: str, level: int = 0) -> tuple:
        name, by = f"{kind}_{uuid.uuid4().hex}", self.KINDS[kind][1]
        df.write.bucketBy(self.buckets, *by).sortBy(*by).option("path", f"{self.path}/{name}").saveAsTable(name)
        return (kind, level, name, self.buckets)

    def _open(self, table: tuple) -> DataFrame:
        kind, _, name, buckets = table
        if not self.spark.catalog.tableExists(name):
            shape, by = self.KINDS[kind][0], ", ".join(self.KINDS[kind][1])
            self.spark.sql(f"CREATE TABLE {name} ({shape}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _each(self, kind: str) -> list[DataFrame]:
        return [self._open(t) for t in self.tables if t[0] == kind]

    def _all(self, kind: str) -> DataFrame:
        every = self.spark.createDataFrame([], self.KINDS[kind][0])
        for df in self._each(kind):
            every = every.unionByName(df)
        return every

    def _drop(self, tables: list[tuple]) -> None:
        for _, _, name, _ in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.path}/{name}")

    def seen(self, batch: DataFrame) -> DataFrame:
        """(fp, k1) of earlier documents that hold a fingerprint of batch (distinct fp) and can tell something of it."""
        out = self.spark.createDataFrame([], "fp long, k1 long")
        for run in self._each("runs"):
            hot = run.filter("salts > 1").select("fp", "salts").distinct()  # at most four times the buckets
            dealt = batch.join(F.broadcast(hot), "fp", "left").select("fp", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
            out = out.union(run.join(dealt, ["fp", "salt"], "left_semi").select("fp", "k1"))
        return out

    def _write_run(self, entries: DataFrame, counts: DataFrame, level: int) -> tuple:
        """Writes entries (fp, k1) as a run; counts (fp, places) has all fingerprints of two places or more."""
        limit = max(TOGETHER, (counts.agg(F.sum("places")).first()[0] or 0) // (4 * self.buckets))
        hot = counts.filter(F.col("places") > limit).select("fp", F.ceil(F.col("places") / limit).cast("int").alias("salts"))
        salted = entries.join(F.broadcast(hot), "fp", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        dealt = salted.select("fp", F.pmod("k1", "salts").cast("int").alias("salt"), "salts", "k1")
        return self._write(dealt.repartition(self.buckets, "fp", "salt"), "runs", level)

    def add(self, docs: DataFrame, text: str = "text", more: bool = True) -> None:
        """Adds a batch of documents: judges its windows, and those of earlier documents that share a fingerprint with it.

        Without `more` no batch can follow, and the batch leaves no run.
        """
        spark, parts, new = self.spark, self.buckets, []
        k1, k2 = text_keys(F.col(f"`{text}`"))
        sketched = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").alias("text")).mapInArrow(_sketch(self.window), _SKETCH)
        firsts = [F.first(c, ignorenulls=True).alias(c) for c in ("n_words", "packed", "places")]
        once = sketched.repartition(parts, "k1").groupBy("k1", "k2").agg(F.sum("copies").alias("copies"), *firsts)
        new.append(self._write(once, "texts"))
        texts, known = self._open(new[0]), self._each("texts")
        if known:
            held, batch = texts, new.pop()
            again = spark.createDataFrame([], self.KINDS["copies"][0])
            for old in known:
                keys = old.select("k1", "k2")
                again = again.union(held.join(keys, ["k1", "k2"], "left_semi").select("k1", "k2", "copies"))
            again = self._write(again, "copies")
            if self._open(again).isEmpty():
                self._drop([again])
                new.append(batch)
            else:
                for old in known:
                    texts = texts.join(old.select("k1", "k2"), ["k1", "k2"], "left_anti")
                new += [again, self._write(texts, "texts")]
                texts = self._open(new[-1])
                self._drop([batch])
        placed = texts.select(F.explode("places").alias("fp"), "k1", F.least("copies", F.lit(2)).alias("weight"))
        counts = placed.groupBy("fp").agg(F.sum("weight").alias("n"), F.count("*").alias("places"))
        counts = materialize(counts if known else counts.filter("n > 1"), "counts")  # all of a batch's meet the runs
        wanted = counts.filter("n > 1").select("fp", "n")
        if known:
            met = materialize(self.seen(counts.select("fp")), "seen")
            old_counts = met.groupBy("fp").agg((F.count("*") + 1).alias("n"))  # with one of the batch at least two
            wanted = materialize(counts.select("fp", "n").unionByName(old_counts).groupBy("fp").agg(F.sum("n").alias("n")).filter("n > 1"), "wanted")

        def stretches(of: DataFrame, places: DataFrame) -> DataFrame:
            marked = places.join(wanted, "fp").groupBy("k1").agg(F.collect_list("fp").alias("fps"), F.collect_list("n").alias("ns"))
            return of.join(marked, "k1").select("k1", "k2", "copies", "packed", "fps", "ns").mapInArrow(_candidates(self.window), _STRETCH)

        distinct = texts.select(F.explode(F.array_distinct("places")).alias("fp"), "k1")
        found = stretches(texts, distinct)
        if known:
            for old in known:
                found = found.union(stretches(old, met))
        dealt = found.repartition(parts, "fp", "salt").sortWithinPartitions("fp", "salt")
        verdicts = materialize(dealt.mapInArrow(_verify(self.window), _VERDICT), "verdicts")
        cover = verdicts.filter("fp IS NULL").select("k1", "k2", "lo", "hi")
        pending = verdicts.filter("words IS NOT NULL")
        if not pending.isEmpty():
            twice = pending.groupBy("fp", "words").agg(F.sum("n").alias("total")).filter("total > 1")
            cover = cover.union(pending.filter("k1 IS NOT NULL").join(twice, ["fp", "words"], "left_semi").select("k1", "k2", "lo", "hi"))
        new.append(self._write(cover.repartition(parts, "k1"), "cover"))
        if more:
            # A text may have several stretches of a fingerprint: only if none of them tells anything new, its entry does not.
            told = verdicts.filter("n = 0").groupBy("fp", "k1").agg(F.count("*").alias("n"), F.max("lo").alias("many")).filter("n = many").select("fp", "k1")
            new.append(self._write_run(distinct.join(told, ["fp", "k1"], "left_anti"), counts.filter("places > 1"), 0))
        self.tables += new
        gone = self._compact() if more else []
        self._commit()
        self._drop(gone)

    def _commit(self) -> None:
        rows = self.spark.createDataFrame(self.tables, "kind string, level int, name string, buckets int").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/state/version={self.version + 1}")
        if self.version:
            delete(self.spark, f"{self.path}/state/version={self.version}")
        self.version += 1

    def _compact(self) -> list[tuple]:
        """Merges tables of one kind and level until no two are left; returns those that others have replaced."""
        gone = []
        for kind in self.KINDS:
            while True:
                mine = sorted([t for t in self.tables if t[0] == kind], key=lambda t: t[1])
                pair = next(([a, b] for a, b in pairwise(mine) if a[1] == b[1]), None)
                if pair is None:
                    break
                both, level = self._open(pair[0]).unionByName(self._open(pair[1])), pair[0][1] + 1
                if kind == "runs":
                    counts = materialize(both.groupBy("fp").agg(F.count("*").alias("places")).filter("places > 1"), "counts")
                    merged = self._write_run(both.select("fp", "k1"), counts, level)
                else:
                    merged = self._write(both.repartition(self.buckets, *self.KINDS[kind][1]), kind, level)
                self.tables = [t for t in self.tables if t not in pair] + [merged]
                gone += pair
        return gone

    def judged(self, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
        """Of every distinct text so far, by its text_keys: k1, k2, n_words, n_removed and kept; see repeated_words."""
        spans = materialize(self._all("cover").groupBy("k1", "k2").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")), "spans")
        more = self._all("copies").groupBy("k1", "k2").agg(F.sum("copies").alias("more"))
        parts = []
        for texts in self._each("texts"):
            counted = texts.join(more, ["k1", "k2"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))) if any(t[0] == "copies" for t in self.tables) else texts
            cut = counted.filter("copies = 1").join(spans, ["k1", "k2"]).select("k1", "k2", "packed", "los", "his").mapInArrow(_cut, "k1 long, k2 long, n_removed long, kept string")
            gone = (F.col("copies") > 1) & (F.col("n_words") >= self.window)
            sizes = counted.select("k1", "k2", F.col("n_words").cast("long").alias("n_words"), "copies")
            parts.append(sizes.join(cut, ["k1", "k2"], "left").select(
                "k1", "k2", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept")
            ))
        done = parts[0]
        for part in parts[1:]:
            done = done.union(part)
        return write(done, "kept")

    def drop(self) -> None:
        """Deletes the index."""
        self._drop(self.tables)
        delete(self.spark, self.path)
        self.tables = []


def repeated_words(docs: DataFrame, text: str = "text", window: int = WINDOW, batches: int = 2) -> DataFrame:
    """Of every distinct text of docs, by its text_keys: k1, k2, n_words, n_removed and kept.

    A word is removed if a window of `window` words around it also starts anywhere else, in this document or another;
    copies of a text are other documents. kept is the other words joined by one space, and null where all words stay.
    Null counts as the empty text, which like any text of fewer words than a window keeps all of them. An empty table
    gives an empty result. The documents go through a SubstringIndex in batches, dealt by hash; the number of batches
    does not change the result.
    """
    with scratch(docs.sparkSession) as keep:
        index = SubstringIndex(docs.sparkSession, window=window)
        for batch in range(batches):
            mine = F.pmod(text_keys(F.col(f"`{text}`"))[1], F.lit(batches)) == batch
            index.add(docs.filter(mine), text, more=batch + 1 < batches)
        done = index.judged(keep)
        index.drop()
    return done


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the words that stay, in docs' columns, whatever their names.

    Texts that lose no word are as they were, n_chars (if there) follows the text, and documents that lose all words go.
    """
    own1, own2, of1, of2, kept, every, met = free_names(docs.columns, "k1", "k2", "of1", "of2", "kept", "all", "met")
    done = repeated_words(docs.select(F.col(f"`{text}`").alias("text"))).filter("n_removed > 0")
    done = done.select(F.col("k1").alias(of1), F.col("k2").alias(of2), F.col("kept").alias(kept), (F.col("n_removed") == F.col("n_words")).alias(every))
    k1, k2 = text_keys(F.col(f"`{text}`"))
    keyed = docs.withColumns({own1: k1, own2: k2})
    marked = sifted(keyed, own1, done.select(F.col(of1).alias(own1)), met)
    joined = marked.filter(met).join(done, (F.col(own1) == F.col(of1)) & (F.col(own2) == F.col(of2)), "left").filter(~F.coalesce(every, F.lit(False)))
    changed = {text: F.coalesce(kept, F.col(f"`{text}`"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length(kept).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    whole = marked.filter(~F.col(met)).select(*[F.col(f"`{c}`") for c in docs.columns])  # most texts are not shuffled
    return whole.union(joined.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns]))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    k1, k2 = text_keys(F.col("text"))
    done = repeated_words(docs)
    keyed = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("all_sha256"))
    return keyed.join(done, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", F.when(F.col("kept").isNull(), F.col("all_sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"))
