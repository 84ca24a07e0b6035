"""Line deduplication that can be undone: sharded cuckoo filters in front of exact reference counts.

A line goes by its key: without white space at both ends, A-Z in lower case, as a 128-bit hash. The index holds, as
immutable tables, the keys of every document (refs), the exact number of documents of every key with the largest of their
ids (counts), and for each shard of the keys a cuckoo filter of those that are counted. A new batch's keys meet the filter
of their shard first: what it does not know is new, and only the rest is joined to the counts. A key whose last document
is deleted goes from the filter as well, which cuckoo filters allow, so deletions leave no trace.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, documents, exists, free_names, materialize, new_path, text_keys

#: Code points that a key needs, and documents that make a line a repeated one.
LEAST, COPIES = 20, 3
#: Of a segment of a filter: buckets, entries of a bucket, share of entries that may be taken. A full filter gets another segment.
BUCKETS, SLOTS, LOAD = 1 << 14, 4, 0.9
#: Segments of a shard at which the filters are made anew with twice as many shards.
SEGMENTS = 8


def line_keys(text: str | None, least: int = LEAST) -> list[bytes | None]:
    """The key of each line, or None for keys of fewer than `least` code points; a null or empty text is one empty line."""
    keys = [x.strip() for x in (text or "").encode().lower().split(b"\n")]  # of bytes, both see ASCII alone
    return [k if len(k) >= 4 * least or len(k) >= least and len(k.decode()) >= least else None for k in keys]


def _digests(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes of keys, as rows of two longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


class CuckooFilter:
    """A multiset of 16-bit fingerprints in segments of buckets; whole arrays of keys go in and out at once.

    A key (two longs) has two buckets, and its fingerprint lies in either one, in any segment. All segments have the same
    buckets, so a fingerprint may be removed from any of them.
    """

    def __init__(self, payload: bytes = b"", buckets: int = BUCKETS):
        self.buckets = buckets
        self.segments = [x.copy() for x in np.frombuffer(payload, "<u2").reshape(-1, buckets, SLOTS)]

    def payload(self) -> bytes:
        return b"".join(x.tobytes() for x in self.segments)

    def _seats(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of each key."""
        bits = keys.view(np.uint64)
        return (bits[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (bits[:, 0] % np.uint64(self.buckets)).astype(np.int64)

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % self.buckets

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Never False for a key that was added and not removed; True for few others."""
        fp, one = self._seats(keys)
        two, found = self._other(fp, one), np.zeros(len(keys), bool)
        for table in self.segments:
            found |= (table[one] == fp[:, None]).any(axis=1) | (table[two] == fp[:, None]).any(axis=1)
        return found

    def add(self, keys: np.ndarray) -> None:
        fp, bucket = self._seats(keys)
        room = int(LOAD * self.buckets * SLOTS)
        at = 0
        while len(fp):
            if at == len(self.segments):
                self.segments.append(np.zeros((self.buckets, SLOTS), np.uint16))
            table = self.segments[at]
            free = max(0, room - int(np.count_nonzero(table)))
            homeless = self._place(table, fp[:free], bucket[:free])
            fp, bucket, at = np.concatenate([homeless[0], fp[free:]]), np.concatenate([homeless[1], bucket[free:]]), at + 1

    def _place(self, table: np.ndarray, fp: np.ndarray, bucket: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """Puts fingerprints into a segment, moving others if need be; returns those that found no place, with a bucket of theirs."""
        dice = np.random.default_rng(len(fp))
        for _ in range(rounds):
            for _ in range(2):
                order = np.argsort(bucket, kind="stable")
                fp, bucket = fp[order], bucket[order]
                rank = np.arange(len(fp)) - np.searchsorted(bucket, bucket)
                taken = table[bucket] != 0
                fits = rank < SLOTS - taken.sum(axis=1)
                slot = np.take_along_axis(np.argsort(taken, axis=1, kind="stable"), np.minimum(rank, SLOTS - 1)[:, None], 1)[:, 0]
                table[bucket[fits], slot[fits]] = fp[fits]
                fp, bucket = fp[~fits], bucket[~fits]
                if not len(fp):
                    return fp, bucket
                bucket = self._other(fp, bucket)
            _, first = np.unique(bucket, return_index=True)
            where, slot = bucket[first], dice.integers(0, SLOTS, len(first))
            fp[first], table[where, slot] = table[where, slot], fp[first].copy()
            bucket[first] = self._other(fp[first], where)
        return fp, bucket

    def remove(self, keys: np.ndarray) -> None:
        """Takes one fingerprint away for each key; the keys have to be in the filter."""
        fp, one = self._seats(keys)
        for table in self.segments:
            flat = table.reshape(-1)
            for _ in range(2):  # of a key, both buckets
                left = np.ones(len(fp), bool)
                while left.any():  # equal fingerprints of a bucket go one after another
                    mine = np.flatnonzero(left)
                    hit = table[one[mine]] == fp[mine][:, None]
                    here = hit.any(axis=1)
                    left[mine[~here]] = False
                    mine, hit = mine[here], hit[here]
                    _, first = np.unique(seat := one[mine] * SLOTS + hit.argmax(axis=1), return_index=True)
                    flat[seat[first]] = 0
                    fp[mine[first]] = 0  # no fingerprint is 0
                    left[mine[first]] = False
                fp, one = fp[stay := fp != 0], one[stay]
                one = self._other(fp, one)
        if len(fp):
            raise ValueError("keys to be removed are not in the filter")


_KEYED = "k1 long, k2 long"
_SIEVE = "shard int, payload binary, k1 long, k2 long, seen boolean"
ADD, FORCE, REMOVE = "add", "force", "remove"


def _sieve(mode: str, buckets: int):
    """Rows of (shard, kind, payload, k1, k2), of a shard the filter first (kind 0), to the keys with `seen` and the filter after them.

    ADD puts in the keys that the filter does not know, FORCE all of them, REMOVE takes all of them out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None

        def done() -> pa.RecordBatch:
            row = ([shard], [held.payload()], [None], [None], [None])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards) | np.diff(kinds)) + 1).tolist(), len(shards)]
            for lo, hi in pairwise(cuts):
                if hi == lo:
                    continue
                if shards[lo] != shard:
                    if held is not None:
                        yield done()
                    shard, held = int(shards[lo]), CuckooFilter(b"", buckets)
                if kinds[lo] == 0:
                    held = CuckooFilter(batch.column(2)[lo].as_py(), buckets)
                    continue
                keys = np.stack([batch.column(i).slice(lo, hi - lo).to_numpy() for i in (3, 4)], axis=1)
                seen = held.contains(keys) if mode == ADD else np.zeros(len(keys), bool)
                held.remove(keys) if mode == REMOVE else held.add(keys[~seen])
                if mode == ADD:
                    columns = [shards[lo:hi], pa.nulls(hi - lo, pa.binary()), keys[:, 0], keys[:, 1], seen]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if held is not None:
            yield done()

    names, types = [x.split()[0] for x in _SIEVE.split(", ")], [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    return run


def _extract(least: int):
    """Rows of (id, t1, t2, text) to the distinct keys of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digests(list({k for k in line_keys(x.as_py(), least) if k is not None})) for x in batch.column(3)]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            every = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            keys = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, i])) for i in (0, 1)], names=["k1", "k2"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, keys)], names=["id", "t1", "t2", "keys"])

    return run


def _cut(least: int):
    """Rows of (..., text, dropped keys) to (..., n_lines, n_dropped, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                lines = (text or "").split("\n")
                if gone.values is None:
                    rows.append((len(lines), 0, text or ""))
                    continue
                of = set(zip(*(gone.values.field(i).to_pylist() for i in (0, 1)), strict=True))
                keys = line_keys(text, least)
                mine = iter(map(tuple, _digests([k for k in keys if k is not None]).tolist()))
                kept = [line for line, key in zip(lines, keys, strict=True) if key is None or next(mine) not in of]
                rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=[*batch.schema.names[:-2], "n_lines", "n_dropped", "kept"])

    return run


class LineIndex:
    """What is known of the lines of all documents so far, as immutable tables in a folder; any session can go on with it.

    refs has the keys of each document by its batch, removed the ids deleted by a later batch, counts the state of keys
    that a batch changed (n documents, the last id; of a key its latest batch counts), filters the filter of each shard.
    Counts are bucketed by key, so that what is stored is not shuffled; those of one level are compacted. The list of
    tables is written as a new version after each batch, and what it no longer names is deleted only then: a batch that
    fails changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, id_type: str = "long", least: int = LEAST, copies: int = COPIES, buckets: int = BUCKETS):
        self.spark, self.least, self.copies, self.buckets, self.id_type = spark, least, copies, buckets, id_type
        self.path = path or new_path(spark, "lines")
        self.version, self.batch, self.shards, self.parts = 0, 0, 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[tuple[str, int, str]] = []  # kind, level, name
        if exists(spark, f"{self.path}/state"):
            state = spark.read.parquet(f"{self.path}/state")
            self.version = state.agg(F.max("version")).first()[0]
            rows = state.filter(F.col("version") == self.version).collect()  # a row for each table
            self.batch, self.shards, self.parts, self.buckets = (rows[0][c] for c in ("batch", "shards", "parts", "buckets"))
            self.tables = sorted((r.kind, r.level, r.name) for r in rows if r.kind != "none")

    def _shape(self, kind: str) -> str:
        return {
            "refs": f"batch long, id {self.id_type}, t1 long, t2 long, keys array<struct<{_KEYED.replace(' long', ': bigint')}>>", "removed": f"batch long, id {self.id_type}",
            "counts": f"{_KEYED}, batch long, n long, last {self.id_type}", "filters": "shard int, payload binary",
        }[kind]

    def _write(self, df: DataFrame, kind: str, level: int = 0) -> tuple[str, int, str]:
        name = f"{kind}_{uuid.uuid4().hex}"
        if kind == "counts":
            df.write.bucketBy(self.parts, "k1").sortBy("k1").option("path", f"{self.path}/{name}").saveAsTable(name)
        else:
            df.write.parquet(f"{self.path}/{name}")
        return (kind, level, name)

    def _open(self, table: tuple[str, int, str]) -> DataFrame:
        kind, _, name = table
        if kind != "counts":
            return self._plain(table)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self._shape(kind)}) USING parquet CLUSTERED BY (k1) SORTED BY (k1) INTO {self.parts} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _all(self, kind: str) -> DataFrame:
        every = self.spark.createDataFrame([], self._shape(kind))
        for table in self.tables:
            if table[0] == kind:
                every = every.unionByName(self._plain(table))
        return every

    def _plain(self, table: tuple[str, int, str]) -> DataFrame:
        """A table without its buckets: Spark takes a union of bucketed tables for bucketed and groups it wrongly, without a shuffle."""
        return self.spark.read.schema(self._shape(table[0])).parquet(f"{self.path}/{table[2]}")

    def _commit(self, new: list[tuple], gone: list[tuple]) -> None:
        """Makes the new tables and the missing old ones the index's state."""
        self.tables = sorted(({*self.tables} | {*new}) - {*gone})
        rows = [(*t, self.batch, self.shards, self.parts, self.buckets) for t in self.tables or [("none", 0, "")]]
        frame = self.spark.createDataFrame(rows, "kind string, level int, name string, batch long, shards int, parts int, buckets int").coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/state/version={self.version + 1}")
        if self.version:
            delete(self.spark, f"{self.path}/state/version={self.version}")
        self.version += 1
        for kind, _, name in gone:
            if kind == "counts":
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.path}/{name}")

    def _live(self) -> DataFrame:
        """refs of documents that were not removed since."""
        refs, removed = self._all("refs"), self._all("removed").withColumnsRenamed({"batch": "until", "id": "gone"})
        if not any(t[0] == "removed" for t in self.tables):
            return refs
        return refs.join(removed, F.col("id").eqNullSafe(F.col("gone")) & (F.col("batch") < F.col("until")), "left_anti")

    def counts(self) -> DataFrame:
        """k1, k2, n and last of every key; n is 0 for keys whose documents are all gone."""
        return self._latest(self._all("counts"))

    def _latest(self, counts: DataFrame) -> DataFrame:
        if sum(t[0] == "counts" for t in self.tables) < 2:
            return counts.drop("batch")  # a table has a key once
        return self._last_batch(counts).drop("batch")

    def _last_batch(self, counts: DataFrame) -> DataFrame:
        return counts.groupBy("k1", "k2").agg(F.max_by(F.struct("batch", "n", "last"), "batch").alias("x")).select("k1", "k2", "x.*")

    def _through(self, keys: DataFrame, filters: DataFrame, mode: str) -> DataFrame:
        """What _sieve makes of keys (k1, k2) and the filters, written."""
        shard = F.pmod(F.xxhash64("k1"), F.lit(self.shards)).cast("int")
        first = filters.select("shard", F.lit(0).alias("kind"), "payload", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
        rest = keys.select(shard.alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("payload"), "k1", "k2")
        dealt = first.unionByName(rest).repartition(self.parts, "shard").sortWithinPartitions("shard", "kind")
        return materialize(dealt.mapInArrow(_sieve(mode, self.buckets), _SIEVE), "sieved")

    def _filters_of(self, sieved: DataFrame) -> DataFrame:
        return sieved.filter("payload IS NOT NULL").select("shard", "payload")

    def _grown(self, filters: DataFrame) -> DataFrame:
        """The filters, made anew from the counts with more shards if some shard has too many segments."""
        limit = SEGMENTS * self.buckets * SLOTS * 2
        if filters.filter(F.length("payload") > limit).isEmpty():
            return filters
        most = filters.agg(F.max(F.length("payload"))).first()[0]
        self.shards *= 1 << max(1, int(np.ceil(np.log2(most / limit))) + 1)
        return self._filters_of(self._through(self.counts().filter("n > 0"), filters.limit(0), FORCE))

    def add(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> None:
        """Adds a batch of documents. Rows are documents, even if they repeat an id or a text, or their id is null."""
        t1, t2 = text_keys(F.col(f"`{text}`"))
        self.batch += 1
        self.shards = self.shards or self.parts
        narrow = docs.select(F.col(f"`{id_column}`").cast(self.id_type).alias("id"), t1.alias("t1"), t2.alias("t2"), F.col(f"`{text}`").alias("text"))
        shape = self._shape("refs").removeprefix("batch long, ")
        new = [self._write(narrow.mapInArrow(_extract(self.least), shape).select(F.lit(self.batch).cast("long").alias("batch"), "*"), "refs")]
        # Summed up before the shuffle, so that a very common line is one row of each task.
        fresh = self._open(new[0]).select("id", F.inline("keys")).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        fresh = materialize(fresh, "line_counts")
        old_filters = [t for t in self.tables if t[0] == "filters"]
        sieved = self._through(fresh, self._all("filters"), ADD)
        filters, maybe = self._filters_of(sieved), sieved.filter("seen").select("k1", "k2")
        found = self.spark.createDataFrame([], self._shape("counts"))
        for table in [t for t in self.tables if t[0] == "counts"]:
            found = found.unionByName(self._open(table).join(maybe, ["k1", "k2"], "left_semi"))  # what is stored is not shuffled
        found = materialize(found, "found_lines")
        known = materialize(self._latest(found).withColumnsRenamed({"n": "n0", "last": "last0"}), "known_lines")
        merged = fresh.join(known, ["k1", "k2"], "left")
        total, last = F.col("n") + F.coalesce("n0", F.lit(0)), F.greatest("last", "last0")
        rows = merged.select("k1", "k2", F.lit(self.batch).cast("long").alias("batch"), total.alias("n"), last.alias("last"))
        new.append(self._write(rows.repartition(self.parts, "k1"), "counts"))
        held = known.filter("n0 > 0")
        false = materialize(maybe.join(held, ["k1", "k2"], "left_anti"), "false_lines")  # the filter took them for others: they are put in after all
        if not false.isEmpty():
            filters = self._filters_of(self._through(false, filters, FORCE))
        self.tables += new
        new = self._compacted(new)
        new.append(self._write(self._grown(filters), "filters"))
        self._commit(new, old_filters + self._replaced)

    def _compacted(self, new: list[tuple]) -> list[tuple]:
        """Merges counts of one level until no two are left."""
        self._replaced: list[tuple] = []
        while True:
            mine = sorted([t for t in self.tables if t[0] == "counts"], key=lambda t: t[1])
            pair = next(([a, b] for a, b in pairwise(mine) if a[1] == b[1]), None)
            if pair is None:
                return [t for t in new if t in self.tables]
            both = self._plain(pair[0]).unionByName(self._plain(pair[1]))
            merged = self._write(self._last_batch(both).repartition(self.parts, "k1"), "counts", pair[0][1] + 1)
            self.tables = [t for t in self.tables if t not in pair] + [merged]
            self._replaced += [t for t in pair if t not in new]
            for t in pair:
                if t in new:
                    self.spark.sql(f"DROP TABLE IF EXISTS {t[2]}")
                    delete(self.spark, f"{self.path}/{t[2]}")
            new = [t for t in new if t not in pair] + [merged]

    def remove(self, ids: DataFrame, id_column: str = "doc_id") -> None:
        """Deletes all documents of the given ids; ids that the index does not hold change nothing. Added again, they count again."""
        self.batch += 1
        gone = materialize(ids.select(F.col(f"`{id_column}`").cast(self.id_type).alias("id")).distinct(), "gone_ids")
        touched = self._live().join(gone.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left_semi")
        touched = materialize(touched.select(F.inline("keys")).distinct(), "touched_lines")
        new = [self._write(gone.select(F.lit(self.batch).cast("long").alias("batch"), "id"), "removed")]
        self.tables += new
        left = self._live().select("id", F.inline("keys")).join(touched, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        rows = touched.join(left, ["k1", "k2"], "left").select("k1", "k2", F.lit(self.batch).cast("long").alias("batch"), F.coalesce("n", F.lit(0)).alias("n"), "last")
        new.append(self._write(rows.repartition(self.parts, "k1"), "counts"))
        self.tables.append(new[-1])
        empty = self._open(new[-1]).filter("n = 0").select("k1", "k2")
        old_filters = [t for t in self.tables if t[0] == "filters"]
        filters = self._filters_of(self._through(empty, self._all("filters"), REMOVE)) if old_filters else self._all("filters")
        new = self._compacted(new)
        new.append(self._write(filters, "filters"))
        self._commit(new, old_filters + self._replaced)

    def repeated(self) -> DataFrame:
        """k1, k2 and last of keys that as many documents hold as make a line a repeated one."""
        return self.counts().filter(F.col("n") >= self.copies).select("k1", "k2", "last")

    def dedup(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """id, t1, t2 (text_keys), n_lines, n_dropped and kept of every row of docs, whose documents the index holds.

        A line goes if its key is repeated and the document is not the last one of that key.
        """
        t1, t2 = text_keys(F.col(f"`{text}`"))
        refs = self._live().select("id", "t1", "t2", F.inline("keys"))
        hits = refs.join(self.repeated(), ["k1", "k2"]).filter(~F.col("id").eqNullSafe(F.col("last")))
        # Documents of one id and one text lose the same lines, so that such a group has no more keys than one text.
        gone = materialize(hits.groupBy("id", "t1", "t2").agg(F.collect_set(F.struct("k1", "k2")).alias("gone")), "gone_lines")
        gone = gone.withColumnsRenamed({"id": "of", "t1": "of1", "t2": "of2"})
        rows = docs.select(F.col(f"`{id_column}`").cast(self.id_type).alias("id"), t1.alias("t1"), t2.alias("t2"), F.col(f"`{text}`").alias("text"))
        same = F.col("id").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("of1")) & (F.col("t2") == F.col("of2"))
        met = rows.join(gone, same, "left").select("id", "t1", "t2", "text", "gone")
        return met.mapInArrow(_cut(self.least), f"id {self.id_type}, t1 long, t2 long, n_lines long, n_dropped long, kept string")

    def drop(self) -> None:
        """Deletes the index."""
        self._commit([], list(self.tables))
        delete(self.spark, self.path)


def kept_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", batches: int = 3, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """id, n_lines, n_dropped and kept (the lines that stay, joined by line breaks) of every row of docs.

    A key of `least` code points or more that `copies` rows or more hold loses all its lines, except in the rows of the
    largest id among them, which keep all of theirs. Null and empty texts are one empty line, which stays. Rows are
    documents: those that repeat an id count each, and stay or go together. A null id is the smallest. Other columns
    are not looked at, whatever their names, and an empty table gives an empty result. The documents go through a
    LineIndex in batches, dealt by hash; their number does not change the result. Keys go by 128-bit hashes.
    """
    index = LineIndex(docs.sparkSession, id_type=docs.select(F.col(f"`{id_column}`")).schema[0].dataType.simpleString(), least=least, copies=copies)
    mine = F.pmod(F.xxhash64(F.col(f"`{id_column}`"), text_keys(F.col(f"`{text}`"))[0]), F.lit(batches))
    for batch in range(batches):
        index.add(docs.filter(mine == batch), id_column, text)
    done = materialize(index.dedup(docs, id_column, text), "kept_lines")
    index.drop()
    return done.drop("t1", "t2")


def remove_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with the texts that kept_lines leaves; a null text stays null where no line goes."""
    index = LineIndex(docs.sparkSession, id_type=docs.select(F.col(f"`{id_column}`")).schema[0].dataType.simpleString())
    index.add(docs, id_column, text)
    (of,) = free_names(docs.columns, "of")
    done = index.dedup(docs, id_column, text).filter("n_dropped > 0").groupBy("id", "t1", "t2").agg(F.first("kept").alias("kept"))
    changed = materialize(done, "kept_lines").select(F.struct("id", "t1", "t2", "kept").alias(of))
    index.drop()
    t1, t2 = text_keys(F.col(f"`{text}`"))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(f"{of}.id")) & (t1 == F.col(f"{of}.t1")) & (t2 == F.col(f"{of}.t2"))
    kept = F.coalesce(F.col(f"{of}.kept"), F.col(f"`{text}`"))
    return docs.join(changed, same, "left").select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of all documents; see kept_lines."""
    done = kept_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
