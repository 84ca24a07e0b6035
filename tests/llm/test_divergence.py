"""The divergence of sources against plain Python in whole numbers, and against its SQL."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credit_engine.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top=50):
    """Of (text, lang, source) rows, all rows of the result."""
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in TERM.findall(text or "")]
        df[lang].update(set(found))
        n[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        whole = sum((n[lang, s] for s in sources), Counter())

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            best = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßÉZ日\x80") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    out = [(None, "en", "s1"), ("", None, None), (" 12 \x00", "en", "only numbers"), ("a_b-C\x00d\x7fe", None, "s1"), (" ".join(words * 300), "de", "long")]
    for i in range(150):
        lang = rng.choice(["en", "en", "de", "", None, "xx"])
        source = rng.choice(["s1", "s1", "s2", "ß", "日", None, "", "s\x00"]) if lang != "xx" else "one"
        text = rng.choice([" ", "\n", "1", "|"]).join(rng.choices(words, k=rng.randint(0, 60)))
        out += [(text, lang, source)] * (1 + (i % 9 == 0))
    return out


@pytest.mark.parametrize(("tile", "terms", "top"), [(512, 20_000, 50), (2, 7, 3), (1, 1000, 50)])
def test_divergence(spark, rows, tile, terms, top, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS", terms)
    docs = spark.createDataFrame([(None if i % 7 == 0 else i // 2, *r, {"a": 1}, -1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, extra map<string,int>, term long").repartition(5)
    found = divergence.divergence(docs, least=10, top=top)
    got = sorted(map(tuple, found.collect()))
    assert got == brute(rows, 10, top) and found.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_nothing_kept(spark, rows):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    none = divergence.divergence(docs, least=10_000).collect()
    assert {r.value for r in none} == {0} and {r.part for r in none} == {"pair"} and sorted(map(tuple, none)) == brute(rows, 10_000)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_blocks_and_batches():
    """Sums are handed on early, and runs go on over batches of any size."""
    texts = [("en", f"s{i % 3}", i, " ".join(f"{'abc'[j % 3]}" for j in range(i % 5))) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts, strict=True)], names=["lang", "source", "document", "text"])
    whole = None
    for held in (1, 4, 10**6):
        divergence.HELD, before = held, divergence.HELD
        rows = [r for b in divergence._count("long")[0](iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()]
        divergence.HELD = before
        rows.sort(key=lambda r: (r["lang"], r["term"], r["source"], r["document"]))
        for size in (1, 2, 5, 1000):
            table = pa.Table.from_pylist(rows)
            runs = [r for b in divergence._scan(20)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
            plain = sorted((r["term"], sorted(zip(r["sources"], r["counts"], strict=True))) for r in runs)
            whole = whole or plain
            assert plain == whole and [t for t, _ in plain] == ["", "a", "b"]


def test_shares_are_exact():
    counts = np.array([0, 7, 10**15, (1 << 62) - 9])
    assert divergence._share(counts, np.int64(1 << 62)).tolist() == [1 + 10**9 * (int(n) + 5) // (1 << 62) for n in counts]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf_dir) / 'documents.parquet'}'")
    found = divergence.op12_source_divergence(spark, sf_dir)
    want = con.execute(divergence.OP12_SQL)
    assert [d[0] for d in want.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall()) and not found.filter(F.col("part") == "term").isEmpty()
