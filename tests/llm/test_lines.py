"""The line index against plain Python: batches, deletions, equal fingerprints, full filters."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from credit_engine.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    return k if len(k) >= 20 else None


def brute(rows):
    """Of (id, text) rows: number of lines, of dropped ones and what stays, in order of rows."""
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            holders[k].append(i)
    last = {k: max((i for i in of if i is not None), default=None) for k, of in holders.items() if len(of) >= 3}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if key(x) not in last or last[key(x)] == i]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common = [f"line number {i} that documents share é" for i in range(12)]
    texts = [None, "", "\n", "   \n\t", "x" * 19 + "\n" + "é" * 20, "é" * 20, "\t" + "É" * 20 + " \n" + "é" * 20, "\x85 " + "y" * 20 + "\xa0", "y" * 20 + "\r", "\n".join(common * 300)]
    for _ in range(60):
        mine = [rng.choice([str.upper, str, lambda x: f" {x}\r"])(rng.choice(common)) for _ in range(rng.randint(0, 6))]
        texts.append("\n".join(mine + [f"own {rng.random()} of this document"] * rng.randint(0, 2)))
    out = list(enumerate(texts)) + [(5, "é" * 20), (5, "é" * 20), (None, common[0]), (None, "null " * 6), (None, "null " * 6 + "\n" + common[1]), (7, "y" * 20)]
    return out + [(200 + i, "null " * 6 if i == 3 else common[i % 3] + f"\n{i}") for i in range(8)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", -1, "k") for i, t in rows], "doc_id long, text string, id string, last long, k1 string").repartition(3)


def result(df):
    return sorted(((r.id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("batches", "buckets"), [(1, 1 << 14), (3, 2), (5, 64)])
def test_kept_lines(spark, rows, batches, buckets, monkeypatch):
    monkeypatch.setattr(lines, "BUCKETS", buckets)
    monkeypatch.setattr(lines.LineIndex.__init__, "__defaults__", (None, "long", 20, 3, buckets))
    assert result(lines.kept_lines(frame(spark, rows), batches=batches)) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("buckets", [2, 1 << 10])
def test_deletions_leave_no_trace(spark, rows, buckets):
    """A batch, a deletion, another batch, a new session, a document that returns: the state is that of what is left."""
    first, second = rows[::2], rows[1::2]
    index = lines.LineIndex(spark, id_type="bigint", buckets=buckets)
    index.add(frame(spark, first))
    gone = {3, 9, 5, 11, 12, 203, None, 99999}
    index.remove(spark.createDataFrame([(i,) for i in [*gone, 3]], "doc_id long"))
    index = lines.LineIndex(spark, index.path, id_type="bigint")
    index.add(frame(spark, second))
    back = [(9, first[0][1]), (12, "line number 1 that documents share é")]
    index.add(frame(spark, back))
    index.remove(spark.createDataFrame([(201,)], "doc_id long"))
    left = [r for r in [*[x for x in first if x[0] not in gone], *second, *back] if r[0] != 201]
    assert result(index.dedup(frame(spark, left))) == sorted(brute(left), key=repr)
    want = defaultdict(int)
    for _, t in left:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            want[tuple(lines._digests([k.encode()])[0].tolist())] += 1
    assert {(r.k1, r.k2): r.n for r in index.counts().filter("n > 0").collect()} == want
    held = sum(int(np.count_nonzero(np.frombuffer(r.payload, "<u2"))) for r in index._all("filters").collect())
    assert held == len(want)
    index.remove(spark.createDataFrame([(i,) for i in {i for i, _ in left}], "doc_id long"))
    assert index.counts().filter("n > 0").isEmpty()
    assert not any(np.frombuffer(r.payload, "<u2").any() for r in index._all("filters").collect())


def test_more_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SEGMENTS", 1)
    rows = [(i, f"a line of its own, {i}\n" * 2 + f"another one of its own, {i % 50}") for i in range(600)]
    index = lines.LineIndex(spark, id_type="bigint", buckets=4)
    index.add(frame(spark, rows[:300]))
    before = index.shards
    index.add(frame(spark, rows[300:]))
    assert index.shards > before
    assert result(index.dedup(frame(spark, rows))) == sorted(brute(rows), key=repr)
    held = sum(int(np.count_nonzero(np.frombuffer(r.payload, "<u2"))) for r in index._all("filters").collect())
    assert held == index.counts().count() == 650


def test_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (150_000, 2))
    held = lines.CuckooFilter()
    held.add(keys[:50_000])
    held.add(keys[50_000:100_000])
    assert held.contains(keys[:100_000]).all() and held.contains(keys[100_000:]).mean() < 0.001 and len(held.segments) == 2
    held = lines.CuckooFilter(held.payload())
    held.remove(keys[:40_000])
    assert held.contains(keys[40_000:100_000]).all() and held.contains(keys[:40_000]).mean() < 0.001
    twice = np.repeat(keys[100_000:100_001], 7, axis=0)  # more equal ones than two buckets hold
    held.add(twice)
    held.remove(twice[:6])
    assert held.contains(twice).all()
    held.remove(twice[:1])
    held.remove(keys[40_000:100_000])
    assert not any(x.any() for x in held.segments)
    with pytest.raises(ValueError, match="not in the filter"):
        held.remove(twice[:1])


def test_empty_and_columns(spark, rows):
    none = frame(spark, rows).limit(0)
    assert lines.kept_lines(none).count() == 0 and lines.remove_lines(none).count() == 0
    docs = frame(spark, rows).withColumns({"m": F.create_map(F.lit("a"), F.lit(1)), "__of": F.lit(1)})
    cleaned = lines.remove_lines(docs)
    assert cleaned.columns == docs.columns
    want = sorted(((i, t if not n else kept) for (i, t), (_, _, n, kept) in zip(rows, brute(rows), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=repr) == want


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = lines.op13_line_dedup(spark, sf_dir)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = sorted((i, n, d, hashlib.sha256(kept.encode()).hexdigest()) for i, n, d, kept in brute(docs))
    assert sorted(map(tuple, got.collect())) == want and sum(r[2] for r in want) > 0
