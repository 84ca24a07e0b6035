"""The alignment of two tokenizers against the libraries and loops over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credit_engine.llm import alignment

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Of (id, text) rows: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    a_lib, b_lib = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a_lib.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    out, held = [], Counter()
    for i, text in rows:
        links, groups, a, b = Counter(), [], [], []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            spell_a = [bytes(alphabet[c] for c in a_lib.id_to_token(x)) for x in a]
            spell_b = [bytes([int(b_lib.id_to_piece(x)[1:-1], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("\u2581", " ").encode() for x in b]
            if not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
                a, b = [], []
        if a:
            ends_a, ends_b, at = [], [], 0
            for x in spell_a:
                ends_a.append(at := at + len(x))
            at = 0
            for x in spell_b:
                ends_b.append(at := at + len(x))
            i_a = i_b = 0
            for cut in sorted({*ends_a} & {*ends_b}):
                j_a, j_b = ends_a.index(cut, i_a) + 1, ends_b.index(cut, i_b) + 1
                groups.append((a[i_a:j_a], b[i_b:j_b]))
                links.update((x, y) for x in a[i_a:j_a] for y in b[i_b:j_b])
                i_a, i_b = j_a, j_b
        held.update(links.keys())
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(i, n_a, n_b, n, sum(links.values()), sum(t for p, t in links.items() if held[p] == most[p[0]]), sum(t * held[p] for p, t in links.items()), sha) for i, n_a, n_b, n, links, sha in out]


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " ", "\n", "a", "one two", "one two", "<|endoftext|> <s> plain </s><|endoftext|>", "with \u2581 mark", "日本語 😀 x\u0301", "\x00\x01 \x7f", "  leading and trailing  ", "a" * 3000, "é" * 500 + "!" * 400,
             " ".join(f"word{i % 97} Überraschung" for i in range(6000)), "\u2581", "ﬁ ½ \xa0 \u3000\u200b", "0123456789" * 200, "\t\t\tif x:\r\n\t\t\t\treturn"]
    return list(enumerate(texts)) + [(4, "a"), (None, "one three"), (4, "again another")]


def got(df):
    return sorted(((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


def test_align(spark, rows):
    docs = spark.createDataFrame([(i, t, -1, {"a": 1}, "x") for i, t in rows], "doc_id long, text string, block long, pairs map<string,int>, id string").repartition(3)
    found = alignment.align(docs, A_FILE, B_FILE)
    assert got(found) == sorted(brute(rows), key=repr)
    assert alignment.align(docs.limit(0), A_FILE, B_FILE).count() == 0
    by_name = alignment.align(docs.select(F.concat(F.lit("n"), F.col("doc_id")).alias("name"), F.col("text").alias("block")), A_FILE, B_FILE, "name", "block")
    assert got(by_name) == sorted(((f"n{r[0]}" if r[0] is not None else None, *r[1:]) for r in brute(rows)), key=repr)


@pytest.mark.parametrize("few", [0, 1, 3, 256])
def test_links_of_large_groups(rows, few, monkeypatch):
    """Groups whose links are made by distinct ids give what others give."""
    own = alignment.Aligner(A_FILE, B_FILE)
    texts = [t for _, t in rows]
    want = alignment.aligner(A_FILE, B_FILE).align(texts)
    monkeypatch.setattr(alignment, "FEW", few)
    monkeypatch.setattr(alignment, "HELD", few + 1)
    parts = [own.align(texts[i : i + 4]) for i in range(0, len(texts), 4)]
    for name, value in {c: [x for part in parts for x in part[c]] for c in want}.items():
        assert list(value) == list(want[name]), name
    assert want["times"].sum() == want["n_links"].sum() and (want["n_overlaps"] >= want["n_groups"]).all() and (want["n_overlaps"] <= want["n_links"]).all()


def test_query(spark, sf_dir, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = alignment.op11_token_alignment(spark, sf_dir)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    assert got(found.withColumnRenamed("doc_id", "id")) == sorted(brute(docs), key=repr)
