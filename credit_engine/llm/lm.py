"""Language-model scores by stupid backoff over n-grams of tokens.

Every text is tokenized once, into a table of blocks of documents. The n-grams of the blocks, of all orders up to the
model's, are exploded to rows (k, gram, block, n), one for each distinct n-gram of a block, and dealt by the hash of the
n-gram into a bucketed table. The count table (k, gram, total) is an aggregate of it with the same buckets, and the join
of the two gives every block the totals of its own n-grams; neither needs a further shuffle. A block's totals come back
to its tokens, and the scores are summed for each document. A very common n-gram is one row of each block it stands in,
however often it stands there, and nothing that grows with the corpus is held in a task or on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, documents, materialize, new_path
from .tokens import encoder, tokenizer_path

BACKOFF, ORDER = 0.4, 2
#: Tokens and documents of a block, at most, before the next document begins another one.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 21, 1 << 13
#: Rows of a batch that goes from Python to Spark.
ROWS = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _code(file: str, width: str):
    """Rows of (id, text) to blocks: their number, the documents' ids and numbers of tokens, and all tokens as `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = encoder(file), TaskContext.get().partitionId(), 0
        ids: list = []
        coded: list[np.ndarray] = []
        size = 0

        def block(kind: pa.DataType) -> pa.RecordBatch:
            row = (part << 32 | number, ids, [len(x) for x in coded], np.concatenate(coded).astype(width).tobytes())
            types = (pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "ids", "lengths", "tokens"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for one, tokens in zip(piece.column(0).to_pylist(), own.encode(piece.column(1).to_pylist()), strict=True):
                    ids.append(one)
                    coded.append(np.frombuffer(tokens, "<u4"))
                    size += len(coded[-1])
                    if size >= BLOCK_TOKENS or len(ids) == BLOCK_DOCS:
                        yield block(kind)
                        ids, coded, size, number = [], [], 0, number + 1
        if ids:
            yield block(kind)

    return run


def _keys(tokens: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k from 1 to the order: a 64-bit key of the k-gram that ends at each token, and whether it lies in one document.

    Keys of one and two tokens are exact, longer ones are hashes.
    """
    token, place = tokens.astype(np.uint64), np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = token
    for k in range(1, order + 1):
        if k > 1:
            before = np.concatenate([np.zeros(1, np.uint64), key[:-1]])
            key = before << np.uint64(32) | token if k == 2 else (before ^ (before >> np.uint64(29))) * _MIX[0] ^ token * _MIX[1]
        yield key, place >= k - 1


def _explode(width: str, order: int):
    """Blocks to their distinct n-grams with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, tokens in zip(batch.column("block").to_pylist(), batch.column("lengths"), batch.column("tokens"), strict=True):
                for k, (key, inside) in enumerate(_keys(np.frombuffer(tokens.as_py(), width), lengths.values.to_numpy().astype(np.int64), order), 1):
                    grams, n = np.unique(key[inside], return_counts=True)
                    for at in range(0, len(grams), ROWS):
                        part = grams[at : at + ROWS]
                        columns = [np.full(len(part), k, np.int8), part.view(np.int64), np.full(len(part), block, np.int64), n[at : at + ROWS].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "gram", "block", "n"])

    return run


def ngram_counts(grams: DataFrame) -> DataFrame:
    """The count table: k, gram and total, from rows of (k, gram, block, n)."""
    return grams.groupBy("gram", "k").agg(F.sum("n").alias("total"))


def _own(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often each token's n-gram (by its number) stands in the token's document."""
    _, at, n = np.unique(gram.astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64), return_inverse=True, return_counts=True)
    return n[at]


def block_scores(tokens: np.ndarray, lengths: np.ndarray, totals: list[tuple[np.ndarray, np.ndarray]], everything: int, leave_out: bool) -> np.ndarray:
    """The sum of log scores of each document of a block; totals has the sorted n-grams and their counts for each k."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    score, before = np.zeros(len(tokens)), None
    for k, ((key, inside), (grams, total)) in enumerate(zip(_keys(tokens, lengths, len(totals)), totals, strict=True), 1):
        at = np.minimum(np.searchsorted(grams, key), max(0, len(grams) - 1))
        found = np.where(inside, total[at], 0) if len(grams) else np.zeros(len(key), np.int64)
        if leave_out:
            numbered = np.where(inside, at, len(grams))
            found = found - np.where(inside, _own(doc, numbered), 0)
        if k == 1:
            others = everything - np.where(leave_out, lengths, 0)[doc]
            score = np.log(np.maximum(found, 1) / np.maximum(others, 1))
        else:
            context = np.concatenate([np.zeros(1, np.int64), before[:-1]])
            direct = np.log(np.maximum(found, 1) / np.maximum(context, 1))
            score = np.where(found > 0, direct, np.where(inside, np.log(BACKOFF), 0.0) + score)
        before = found
    return np.bincount(doc, score, len(lengths))


def _score(width: str, order: int, everything: int, leave_out: bool):
    """Blocks with their totals to id, n_tokens and log_sum of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, tokens, parts in zip(*[batch.column(c) for c in ("ids", "lengths", "tokens", "parts")], strict=True):
                lengths = lengths.values.to_numpy().astype(np.int64)
                rows = pa.array([], pa.struct([("k", pa.int8()), ("gram", pa.int64()), ("total", pa.int64())])) if parts.values is None else parts.values
                of, grams, counts = (rows.field(c).to_numpy() for c in ("k", "gram", "total"))
                grams, totals = grams.view(np.uint64), []
                for k in range(1, order + 1):
                    mine = of == k
                    way = np.argsort(grams[mine])
                    totals.append((grams[mine][way], counts[mine][way]))
                sums = block_scores(np.frombuffer(tokens.as_py(), width), lengths, totals, everything, leave_out)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(lengths), pa.array(sums)], names=["id", "n_tokens", "log_sum"])

    return run


def score(docs: DataFrame, tokenizer_file: str, vocabulary: int, id_column: str = "doc_id", text: str = "text", order: int = ORDER, leave_out: bool = False) -> DataFrame:
    """id, n_tokens, log_score and mean_log_score of every row of docs under a model of all docs.

    A token w after the context c (the order - 1 tokens before it in its document, fewer near the begin) scores
    f(c w) / f(c) if that is positive, else 0.4 times its score after c without its first token; without context it
    scores f(w) / N. With leave_out all counts are those of the other documents, so that no document vouches for itself;
    a token that they lack counts as one there. log_score adds up the logarithms. A null or empty text has no tokens,
    score 0 and a null mean. Equal texts score alike, rows that repeat an id stay rows, extra columns are not looked at,
    and an empty table gives an empty result. A token id that `vocabulary` does not cover is an error.
    """
    if order < 1:
        raise ValueError("the order must be 1 or more")
    spark, width = docs.sparkSession, "<u2" if vocabulary <= 1 << 16 else "<u4"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.select(F.col(f"`{id_column}`")).schema[0].dataType.simpleString()
    shape = f"block long, ids array<{kind}>, lengths array<int>, tokens binary"
    made = {x: (f"{x}_{uuid.uuid4().hex}", new_path(spark, x)) for x in ("coded", "grams")}

    def bucketed(df: DataFrame, name: str, by: str) -> None:
        df.write.bucketBy(parts, by).sortBy(by).option("compression", "zstd").option("path", made[name][1]).saveAsTable(made[name][0])

    check_vocabulary(tokenizer_file, vocabulary)
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # Bucketed by block, so that the totals come to the tokens and these are not shuffled.
    bucketed(narrow.mapInArrow(_code(tokenizer_file, width), shape), "coded", "block")
    blocks = spark.read.schema(shape).parquet(made["coded"][1])
    exploded = blocks.select("block", "lengths", "tokens").mapInArrow(_explode(width, order), "k byte, gram long, block long, n int")
    bucketed(exploded.repartition(parts, "gram"), "grams", "gram")
    grams = spark.table(made["grams"][0])
    everything = grams.filter("k = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = grams.join(ngram_counts(grams), ["gram", "k"])
    gathered = met.groupBy("block").agg(F.collect_list(F.struct("k", "gram", "total")).alias("parts"))  # no more than a block's own n-grams
    joined = spark.table(made["coded"][0]).join(gathered, "block", "left").select("ids", "lengths", "tokens", "parts")
    scored = materialize(joined.mapInArrow(_score(width, order, everything, leave_out), f"id {kind}, n_tokens long, log_sum double"), "scores")
    for name, folder in made.values():
        spark.sql(f"DROP TABLE {name}")
        delete(spark, folder)
    log = F.round("log_sum", 6)
    return scored.select(F.col("id").alias(id_column), "n_tokens", log.alias("log_score"), F.when(F.col("n_tokens") > 0, F.round(F.col("log_sum") / F.col("n_tokens"), 6)).alias("mean_log_score"))


def check_vocabulary(tokenizer_file: str, vocabulary: int) -> None:
    """Raises ValueError if the tokenizer has ids that `vocabulary` does not cover, which would not fit the tokens' width."""
    most = encoder(tokenizer_file).tokenizer.get_vocab_size(with_added_tokens=True)
    if most > vocabulary:
        raise ValueError(f"the tokenizer has {most} ids, more than the vocabulary of {vocabulary}")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_score and mean_log_score of all documents, each under a bigram model of all others."""
    return score(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path(), 50257, leave_out=True)
