"""Token ids of whole texts, written as Simple-8b files and read back."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simple8b
from .shared import documents, new_path, text_keys

#: Ids a file holds before the next document begins another one; encoded chunks a worker holds before it forgets them.
FILE_IDS, HELD = 1 << 20, 1_000_000
END_ID = 0

#: No token of a byte-level BPE goes on from other characters into white space, so a text may be cut there.
_CHUNKS = re.compile(r"\s*\S+(?:[^\S \t\n\r\x0b\x0c]\s*\S*)*|\s+").findall
#: Words encoded as one text when they are new.
TOGETHER = 200


def _odd(missing: set[str]) -> set[str]:
    """Those that, but for a line break before them, are no word: empty ones, and ones with other white space. Most often
    there are none but empty ones, which one split of all tells."""
    empty = missing & {"", "\n"}
    rest = [w.removeprefix("\n") for w in missing - empty]
    if " ".join(rest).split() == rest:
        return empty
    return {w for w in missing if w.removeprefix("\n").split() != [w.removeprefix("\n")]}


def _uncached(tokenizer):
    """tokenizer, if it is BPE, without the library's own cache: TextEncoder knows the words itself, so none would be met there again."""
    from tokenizers.models import BPE

    if isinstance(tokenizer.model, BPE):
        made = json.loads(tokenizer.to_str())["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in made["merges"]]
        options = {k: v for k, v in made.items() if k not in ("type", "vocab", "merges") and v is not None}
        tokenizer.model = BPE(made["vocab"], merges, cache_capacity=0, **options)
    return tokenizer


class TextEncoder:
    """Ids of texts by the tokenizers library, which sees every distinct chunk of a batch once.

    Where all white space is single spaces and line breaks between other characters, the chunks are the words, each with
    the space or the line break before it; other texts are cut by a pattern. Texts that hold an added token's string go
    to the library whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = _uncached(Tokenizer.from_file(file))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # they are cut out before words are
        self.known: dict[str, bytes] = {}  # by chunk
        self.words: dict[str, bytes] = {}  # by word, after a space unless it begins with a line break
        self.line, *more = self._ids(["\n"])[0]
        self.even = not more and [self._ids([x])[0].tolist() for x in ("a\nb", "a\n b")] == [[*self._ids(["a"])[0], self.line, *self._ids([x])[0]] for x in ("b", " b")]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, missing: set[str]) -> None:
        """Encodes new words as lines of one text; a line break is a token by itself there, so it parts their ids."""
        line = np.array([self.line], "<u4")
        begun = {w for w in missing if w[0] == "\n"}
        for after_line, found in ((False, list(missing - begun)), (True, list(begun))):
            parts = [found[i : i + TOGETHER] for i in range(0, len(found), TOGETHER)]
            lines = ["\n".join([w[1:] if after_line else " " + w for w in part]) for part in parts]
            ids = np.concatenate([line, *(x for one in self._ids(lines) for x in (one, line))])
            marks = 4 * np.flatnonzero(ids == self.line)
            starts, ends, coded = marks[:-1] if after_line else marks[:-1] + 4, marks[1:], ids.tobytes()
            self.words.update(zip(found, [coded[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        known, words = self.known, self.words
        whole = {i: t for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        if whole:
            texts = [None if i in whole else t for i, t in enumerate(texts)]
        # A line break goes before each text, so that its first word is one like all others; its id is left out again.
        flat: list[str] = []
        bounds = [0]
        for t in texts:
            flat += ("\n" + (t or "")).replace("\n", " \n")[1:].split(" ")
            bounds.append(len(flat))
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        coded = list(map(words.get, flat))
        new = [i for i, ids in enumerate(coded) if ids is None]
        missing = {flat[i] for i in new}
        odd = _odd(missing) if self.even else missing
        self._learn_words(missing - odd if odd else missing)
        for i, ids in zip(new, map(words.get, map(flat.__getitem__, new)), strict=True):
            coded[i] = ids
        even = [odd.isdisjoint(flat[a:b]) for a, b in spans] if odd else [True] * len(spans)
        chunked = {i: _CHUNKS(t) for i, (t, e) in enumerate(zip(texts, even, strict=True)) if t and not e}
        missing = set().union(*chunked.values()).difference(known)
        for part in batched(missing, 20_000):
            known.update(zip(part, [x.tobytes() for x in self._ids(list(part))], strict=True))
        out = [b"".join(coded[a:b])[4:] if e else b"".join(map(known.__getitem__, chunked.get(i, []))) for i, ((a, b), e) in enumerate(zip(spans, even, strict=True))]
        for i, ids in zip(whole, self._ids(list(whole.values())) if whole else [], strict=True):
            out[i] = ids.tobytes()
        for held in (known, words):
            if len(held) > HELD:
                held.clear()
        return out


_encoders: dict[str, TextEncoder] = {}


def encoder(file: str) -> TextEncoder:
    if file not in _encoders:
        _encoders[file] = TextEncoder(file)
    return _encoders[file]


_FILE = "part int, file int, before long, n_tokens long, doc_ids array<long>, lengths array<int>, payload binary"


def write_files(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of docs, in ascending order of their ids, as files of the format (a row each) to the folder `path`.

    A row has the range of ids it belongs to (part), its number and the tokens before it there, its documents and their
    numbers of tokens, and as payload the Simple-8b file of all their token ids. Null and empty texts have the end id
    only; null ids come first, and rows that repeat an id stay rows, in the order of their texts' hashes, so that reruns
    agree. Spark writes, so `path` may be in any store.
    """
    narrow = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_keys(F.col(f"`{text}`"))[0].alias("tie"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, file, before = encoder(tokenizer_file), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        coded: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal file, before, size, ids, coded
            data = simple8b.encode(np.frombuffer(b"".join(coded), "<u4"))
            row = (part, file, before, size, ids, [len(c) // 4 for c in coded], data)
            file, before, size, ids, coded = file + 1, before + size, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                for doc_id, one in zip(piece.column(0).to_pylist(), own.encode(piece.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    coded.append(one + end)
                    size += len(coded[-1]) // 4
                    if size >= FILE_IDS:
                        yield flush()
        if ids:
            yield flush()

    names = [x.split()[0] for x in _FILE.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    narrow.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(run, _FILE).write.parquet(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens and ids_crc32 of every document in the files; ids if asked for."""
    files = spark.read.schema(_FILE).parquet(path)
    # One row for each range of ids, not for each document, goes through the window.
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    starts = sizes.select("part", (F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("start"))
    # That table has at most spark.sql.shuffle.partitions rows of two numbers, so it is broadcast and no payload is shuffled.
    placed = files.join(F.broadcast(starts), "part").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, lengths, payload in zip(*batch.columns, strict=True):
                ids = simple8b.decode(payload.as_py()).astype("<u4")
                sizes = lengths.values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                bounds = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                columns = [
                    doc_ids.values, pa.array(first.as_py() + ends - sizes), pa.array(sizes),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in bounds], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return placed.mapInArrow(run, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, read back from the files they were written to."""
    path = new_path(spark, "token_files")
    write_files(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path(), path)
    return read_files(spark, path)
