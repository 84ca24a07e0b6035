"""Near-duplicates by similarity of word shingles: SimHash and banded minimum hashes find candidates, whole shingle sets verify them.

First come fingerprints of the shingle sets: the anchors of the SimHash operator find all that differ in at most 3 bits,
and what these link is one component before anything else is looked at. Bands of minima then go on from these components,
for the similar texts whose fingerprints are further apart; texts of one component are not compared again.

Two texts meet in a band if all ROWS minima of one of BANDS bands agree: of pairs with Jaccard similarity 0.8, 1 - (1 - 0.8**5)**25 =
99.995 % do, of more similar ones more. Parity bits of a set bound its symmetric difference with another from below, which
rules most other pairs of a bucket out at no loss; the rest are compared by their whole sets of 64-bit shingle hashes.
A text goes by two hashes (k1, k2) of 64 bits throughout. Anchors alone cannot do this within the limits: at 0.8 a bit of
a fingerprint differs with probability 0.15, see the README.

Large buckets are dealt to tiles, and linked in three steps: a spanning forest in each tile; forests of one representative
of each component, until these tell nothing new; then every text outside a bucket's largest component against all texts
of other components. A crowd of near copies is one component by then, so its rows do not grow with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, scratch, sieve, text_keys
from .simhash import first_rows, majority, near_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Buckets with more texts than this are linked by a forest first; larger ones than TILE are dealt to tiles of that size.
FEW, TILE = 16, 2048
_PAIR = "s1 long, s2 long, d1 long, d2 long"
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; ASCII case does not count, fewer words are one shingle."""
    w = (text if isinstance(text, bytes) else (text or "").encode()).lower().split()
    runs = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, max(1, len(w) - size + 1)))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of a shingle set, and the parity of the set in each of 256 classes as four words."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(least, (found[i : i + 2048, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.array(keys, np.uint64).view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), size) for x in batch.column("text")]
            signed = [signature(x) for x in sets]
            fps = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array(fps), *[pa.array([x[i] for x in signed], pa.list_(pa.int64())) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "n", "fp", "keys", "parity"])

    return run


def _possible(size: np.ndarray, parity: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets i and j (that broadcast) may be similar: the difference is at least their parities'."""
    a, b = size[i], size[j]
    differ = sum(np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).astype(np.int64) for p in parity)  # of a negative number it would count the absolute value's
    most = (a + b) * (1 - similarity) / (1 + similarity)
    return np.maximum(differ, np.abs(a - b)) <= most + 1e-6


def _numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a, b), the same for equal ones, in their order."""
    order = np.lexsort((b, a))
    new = np.concatenate([[False], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def _pairs(similarity: float, labelled: bool):
    """Rows (bucket, tile, k1, k2, n, l1, l2, parities) in order of bucket and tile to its possible pairs: all in small
    tiles; in others a forest, or with `labelled` all across labels (l1, l2). Pairs of one label never count."""

    def pick(rows: np.ndarray, few: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, first = np.unique(_numbers(rows[2], rows[3]), return_index=True)  # a text once
        node, size, label, parity = rows[2:4, first], rows[4, first], _numbers(rows[5, first], rows[6, first]), rows[7:, first]
        count = len(first)
        if count < 2 or not label.any():
            return
        left = np.arange(count)
        step = max(1, (1 << 21) // count)
        if labelled or count <= few:
            for at in range(0, count, step):
                i = left[at : at + step, None]
                ok = (i < left) & _possible(size, parity, i, left[None, :], similarity)
                a, b = np.nonzero(ok & (label[i] != label[None, :]))
                yield node, a + at, b
            return
        while len(left) > 1:
            frontier, left = left[:1], left[1:]
            while len(frontier) and len(left):
                head, frontier = frontier[:step], frontier[step:]
                ok = _possible(size, parity, head[:, None], left[None, :], similarity)
                hit = ok.any(axis=0)
                a, b = head[ok[:, hit].argmax(axis=0)], left[hit]
                apart = label[a] != label[b]
                yield node, a[apart], b[apart]
                frontier, left = np.concatenate([frontier, left[hit]]), left[~hit]

    def found(rows: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo > 1:
                for node, a, b in pick(rows[:, lo:hi], FEW):
                    if len(a):
                        low, high = np.minimum(a, b), np.maximum(a, b)
                        yield pa.RecordBatch.from_arrays([pa.array(node[i, x]) for x in (low, high) for i in (0, 1)], names=["s1", "s2", "d1", "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            starts = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            last = starts[-1] if len(starts) else 0
            rest = rows[:, last:]
            if last:
                yield from found(rows, np.concatenate([[0], starts]))
        if rest is not None and rest.shape[1]:
            yield from found(rest, np.array([0, rest.shape[1]]))

    return run


def _verify(similarity: float, size: int):
    """Rows of (s1, s2, d1, d2) with both packed texts to those whose shingle sets are similar; a text is unpacked once for neighbouring rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        found = lru_cache(64)(lambda packed: shingles(unpack(packed), size))
        for batch in batches:
            ok = [similar(found(x), found(y), similarity) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["s1", "s2", "d1", "d2"]).filter(pa.array(ok, pa.bool_()))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts go to their pairs packed: a set's hashes do not shrink, and are five times as long."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [pack((x.as_py() or "").encode()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["k1", "k2", "packed"])


def near_roots(docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `_roots`, written; all other tables on the way to them are deleted."""
    with scratch(docs.sparkSession) as keep:
        return keep(_roots(docs, text, id_column, shingle, similarity), "roots")


def _roots(docs: DataFrame, text: str, id_column: str, shingle: int, similarity: float) -> DataFrame:
    """id, k1, k2 (the text_keys) and root (a struct of such keys) of every row of docs; texts that links of at least
    `similarity` join share a root.

    Null counts as empty; texts of fewer words than a shingle are similar only if they are equal. Rows that repeat an id
    or a text stay rows, null ids are ids, other columns are not looked at, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k1, k2 = text_keys(F.col(f"`{text}`"))
    keyed = docs.select(F.col(f"`{id_column}`").alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    signed = materialize(keyed.mapInArrow(_sign(shingle), f"id {kind}, k1 long, k2 long, n long, fp long, keys array<long>, parity array<long>"), "signatures")
    nodes = materialize(signed.drop("id").dropDuplicates(["k1", "k2"]), "nodes")
    node = F.struct("k1", "k2")
    parities = [f"p{i}" for i in range(1, 5)]
    crowds = materialize(nodes.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("many")).filter(F.col("many") > 1), "crowds")
    tiles = F.ceil(F.col("many") / TILE).cast("int")
    own = F.pmod(F.xxhash64("bucket", "k1", "k2"), tiles).cast("int")  # other tiles in each bucket, so that these connect across tiles too

    def candidates(rows: DataFrame, tile, labelled: bool) -> DataFrame:
        """Pairs to verify of rows (bucket, k1, k2, n, root, parities); `tile` is a row's tile."""
        dealt = rows.select("bucket", tile.alias("tile"), "k1", "k2", "n", "root.k1", "root.k2", *parities).toDF("bucket", "tile", "k1", "k2", "n", "l1", "l2", *parities)
        sorted_ = dealt.repartition(parts, "bucket", "tile").sortWithinPartitions("bucket", "tile")
        return materialize(sorted_.mapInArrow(_pairs(similarity, labelled), _PAIR).distinct(), "candidates")

    def fingerprinted() -> DataFrame:
        """Pairs to verify of texts whose fingerprints are equal or linked; one text stands for all of a fingerprint."""
        firsts = materialize(nodes.groupBy("fp").agg(F.min(node).alias("first")), "fingerprints")
        equal = nodes.select("fp", node.alias("other")).join(firsts, "fp").filter("first != other").select("first", "other")
        a, b = firsts.toDF("src", "a"), firsts.toDF("dst", "b")
        linked = near_links(firsts.select("fp")).join(a, "src").join(b, "dst").select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("other"))
        return materialize(equal.union(linked).select("first.k1", "first.k2", "other.k1", "other.k2").toDF("s1", "s2", "d1", "d2"), "candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = materialize(pairs.select(F.col("s1").alias("k1"), F.col("s2").alias("k2")).union(pairs.select("d1", "d2")).distinct(), "wanted")
        packed = sieve(keyed.select("k1", "k2", "text"), "k1", wanted).mapInArrow(_pack, "k1 long, k2 long, packed binary")
        texts = materialize(packed.join(wanted, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), "texts")
        a, b = (texts.toDF(f"{x}1", f"{x}2", y) for x, y in (("s", "a"), ("d", "b")))
        joined = pairs.join(a, ["s1", "s2"]).join(b, ["d1", "d2"]).select("s1", "s2", "d1", "d2", "a", "b")
        return materialize(joined.mapInArrow(_verify(similarity, shingle), _PAIR).select(F.struct(F.col("s1").alias("k1"), F.col("s2").alias("k2")).alias("src"), F.struct(F.col("d1").alias("k1"), F.col("d2").alias("k2")).alias("dst")), "links")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """rows with root, that of the component, or the row's own keys."""
        of = roots.select(F.col("node.k1").alias("n1"), F.col("node.k2").alias("n2"), "component")
        joined = rows.join(of, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")), "left")
        return joined.withColumn("root", F.coalesce("component", node)).drop("n1", "n2", "component")

    def met(roots: DataFrame, over: int) -> DataFrame:
        """A row for each text and bucket of more than `over` texts, with the text's root."""
        placed = rooted(nodes, roots).select(F.explode("keys").alias("bucket"), "k1", "k2", "n", "root", *[F.element_at("parity", i).alias(p) for i, p in enumerate(parities, 1)])
        wanted = crowds.filter(F.col("many") > over)
        return sieve(placed, "bucket", wanted).join(wanted, "bucket")

    links = verified(fingerprinted())
    roots = materialize(connected_components(links), "components")
    links = links.union(verified(candidates(met(roots, 1), own, False)))
    roots = materialize(connected_components(links), "components")
    if not crowds.filter(F.col("many") > TILE).isEmpty():
        while True:
            # One text of each component of a large bucket; each round at least one link joins two of them, or it is the last one.
            least = F.min(F.struct("k1", "k2", "n", *parities)).alias("x")
            several = met(roots, TILE).groupBy("bucket", "root").agg(least).select("bucket", "root", "x.*")
            counted = several.join(several.groupBy("bucket").agg(F.count("*").alias("many")).filter(F.col("many") > 1), "bucket")
            more = verified(candidates(counted, own, False))
            if more.isEmpty():
                break
            links = links.union(more)
            roots = materialize(connected_components(links), "components")
    # What is not connected yet is compared across components. Of any two components one is not the bucket's largest one,
    # so that those of the largest one stay in their tiles and only the others go to all.
    rest = met(roots, FEW)
    sizes = rest.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("most"), F.count("*").alias("components")).filter("components > 1")
    others = rest.join(largest, "bucket")
    everywhere = F.explode(F.when(F.col("root") == F.col("most"), F.array("own")).otherwise(F.sequence(F.lit(0), tiles - 1)))
    spread = others.withColumn("own", own).select("*", everywhere.alias("tile"))
    more = candidates(spread, F.col("tile"), True)
    if not more.isEmpty():
        roots = connected_components(links.union(verified(more)))
    return rooted(signed, roots).select("id", "k1", "k2", "root")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each component of near-duplicates: see first_rows."""
    return first_rows(docs, near_roots(docs, text, id_column, shingle, similarity), id_column, text)
