"""Near-dedup: clashing keys, crowds over many tiles, columns of any type."""

import random

import pytest
from pyspark.sql import functions as F

from credit_engine.llm import near, shared, simhash, substrings


def say(rng, n):
    return [str(rng.randrange(10**6)) for _ in range(n)]


@pytest.mark.parametrize("kept", [0, 1])
def test_texts_of_one_hash_stay_apart(spark, kept, monkeypatch):
    """One of the two keys is the same for all texts: none is taken for another one."""

    def keys(text):
        mine = F.xxhash64(F.coalesce(text, F.lit("")))
        return (mine, F.lit(7).cast("long")) if kept == 0 else (F.lit(7).cast("long"), mine)

    for module in (near, simhash):
        monkeypatch.setattr(module, "text_keys", keys)
    rng = random.Random(1)
    texts = [" ".join(say(rng, 50)) for _ in range(30)]
    rows = list(enumerate(texts + [t + " more" for t in texts[:10]] + texts[20:25]))
    left = near.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in left.collect()) == list(range(30))


def test_columns_of_any_type(spark):
    text = " ".join(say(random.Random(2), 40))
    schema = "doc_id long, text string, m map<string,int>, s struct<a: int, b: array<map<int,string>>>, root string, k1 long, bucket binary"
    rows = [(1, text, {"a": 1}, (1, [{1: "x"}]), "r", 1, b"x"), (1, text, {"a": 1}, (1, [{1: "x"}]), "r", 1, b"x"), (1, text, {"a": 0}, (2, None), None, 2, None), (2, text + " end", None, None, None, None, None)]
    for keep_first in (near.keep_first, simhash.keep_first):
        kept = keep_first(spark.createDataFrame(rows, schema))
        assert kept.columns == ["doc_id", "text", "m", "s", "root", "k1", "bucket"]
        found = [r for r in kept.collect() if r.doc_id == 1]
        assert len(found) == 1 and found[0].m == {"a": 0} and found[0].s.a == 2


@pytest.mark.parametrize("name", ["near", "simhash"])
def test_empty_table(spark, name):
    none = spark.createDataFrame([], "doc_id long, text string, m map<string,int>")
    assert {"near": near, "simhash": simhash}[name].keep_first(none).count() == 0


def test_greater_distances_are_refused(spark):
    with pytest.raises(ValueError, match="3 differing bits"):
        simhash.near_links(spark.range(3).withColumnRenamed("id", "fp"), 4)


def test_crowds_grow_in_proportion(spark, monkeypatch):
    """A crowd of near copies over 40 tiles is one component, a text that only one of them is near to joins it, strangers do
    not; the rows that are compared are a few for each text and band, not one for each tile."""
    monkeypatch.setattr(near, "TILE", 100)
    rng = random.Random(3)
    base = say(rng, 60)
    crowd = [" ".join([*base, f"copy{i}", f"of{i}"]) for i in range(4000)]  # 58 of 66 shingles are common: 0.93 with the base, 0.88 with each other
    edited = list(base)
    edited[20] = "edit"
    chain = [" ".join([*base[:-1], "x", "y"]), " ".join(edited)]
    strangers = [" ".join(say(rng, 60)) for _ in range(50)]
    seen = []
    real = near.materialize

    def watched(df, name):
        made = real(df, name)
        seen.append((name, made.count()))
        return made

    monkeypatch.setattr(near, "materialize", watched)
    rows = list(enumerate(crowd + strangers + chain))
    roots = near.near_roots(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len({r.root for r in roots if r.id < 4000}) == 1 and len({r.root for r in roots}) == 51
    compared = sum(n for name, n in seen if name == "candidates")
    assert compared < 25 * 3 * 4000  # a spanning forest has a link for each text and bucket


def test_fingerprints_link_first(spark, monkeypatch):
    """Texts whose fingerprints differ in at most 3 bits are linked by the anchors, and bands do not look at them again."""
    rng = random.Random(4)
    base = [say(rng, 2000) for _ in range(10)]
    texts = [" ".join(x) for x in base] + [" ".join([*x, "end"]) for x in base] + [" ".join(say(rng, 50)) for _ in range(10)]
    fps = [simhash.majority(near.shingles(t)) for t in texts]
    close = [i for i in range(10) if (fps[i] ^ fps[i + 10]).bit_count() <= 3]
    seen, real = [], near.materialize

    def watched(df, name):
        made = real(df, name)
        seen.append((name, made.count()))
        return made

    monkeypatch.setattr(near, "materialize", watched)
    roots = near.near_roots(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(close) > 7 and len({r.root for r in roots}) == 20
    assert [n for name, n in seen if name == "links"][0] == len(close)
    assert [n for name, n in seen if name == "candidates"][:2] == [len(close), 10 - len(close)]


def test_sieve_loses_nothing(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), "id")
    wanted = rows.filter("id % 50 = 0")
    left = {r.id for r in shared.sieve(rows, "k", wanted).collect()}
    assert {*range(0, 20_000, 50)} <= left and len(left) < 4_000
    assert shared.sieve(rows, "k", wanted.limit(0)).count() == 0


def test_only_what_results_are_read_from_stays(spark, tmp_path, monkeypatch):
    """The tables on the way to a result are deleted when it is written, so that they do not add up over the pipeline's stages."""
    rng = random.Random(9)
    texts = [" ".join(say(rng, 60)) for _ in range(40)]
    texts += [t + " more" for t in texts[:10]] + [t + " " + " ".join(say(rng, 60)) for t in texts[10:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    left = lambda: sorted(p.name.rsplit("_", 1)[0] for p in tmp_path.glob("tables/*/*"))
    kept = near.keep_first(docs)
    assert kept.count() == 50 and left() == ["chosen", "others", "roots"]
    assert substrings.remove_repeats(kept).count() == 40 and left() == ["chosen", "kept", "others", "roots"]


def test_most_texts_are_not_shuffled(spark):
    """Only rows that may go meet a join: of the others not one leaves its partition, whatever size Spark broadcasts up to."""
    rng = random.Random(10)
    rows = [(i, " ".join(say(rng, 40))) for i in range(2000)]
    rows += [(2000 + i, t + " more") for i, t in rows[:20]] + [(None, "a b c d e f"), (5, rows[5][1]), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    marked = shared.sifted(docs.withColumn("k", F.xxhash64("text")), "k", docs.filter("doc_id >= 2000").select(F.xxhash64("text").alias("k")), "met")
    assert sorted(r.doc_id for r in marked.filter("met AND doc_id >= 2000").collect()) == list(range(2000, 2020))
    assert marked.count() == len(rows) and marked.filter("met").count() < 300
    assert "Exchange hashpartitioning(text" not in marked._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in near.keep_first(docs).collect() if r.doc_id is not None) == list(range(2000))
    assert near.keep_first(docs).filter("doc_id IS NULL").count() == 1
