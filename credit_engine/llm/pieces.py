"""SentencePiece encoding and decoding with a merge-type (BPE) model by a prefix table.

A sequence of tokens is the model's encoding of its text if every two neighbours, and every token by itself, are what
merging makes of their own text. So each prefix of a segment has one last token: of the vocabulary's words that end
there, as an Aho-Corasick automaton finds them, the one that is compatible with the last token of the prefix before it.
The table is filled left to right, and the ids are read from it backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

SPACE = "▁"
#: Encoded segments and judged pairs that a worker holds at most; then it forgets them all.
HELD = 300_000


class PieceCodec:
    """Ids of texts and texts of ids, for models with identity normalisation, byte fallback and a dummy prefix."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.score: dict[str, tuple[float, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.piece: list[bytes] = []
        self.is_byte: set[int] = set()
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.is_byte.add(i)
                self.piece.append(bytes([value]))
            elif model.is_control(i):
                self.piece.append(b"")
            elif model.is_unknown(i):
                self.piece.append(" ⁇ ".encode())
            else:
                self.score[piece] = (model.get_score(i), i)
                self.piece.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece spans several words; segments would have to be longer")
        many = {c for p in self.score if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in many)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]").findall
        self.text = {i: p for p, (_, i) in self.score.items()}
        self.characters = {p for p in self.score if len(p) == 1}
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) == 1 or self._merge(piece) == [piece]:
                i = self.score[piece][1]
                self.automaton.add_word(piece, (i, len(piece), i.to_bytes(4, "little")))
        self.automaton.make_automaton()

    def _merge(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                found = self.score.get(parts[i] + parts[i + 1])
                if found and (best is None or found[0] > best[0]):
                    best = (found[0], i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _compatible(self, key: int) -> bool:
        """Whether merging leaves the two pieces of a key as they are."""
        if len(self.pairs) >= HELD:
            self.pairs.clear()
        left, right = self.text[key >> 20], self.text[key & 0xFFFFF]
        answer = self.pairs[key] = self._merge(left + right) == [left, right]
        return answer

    def _segment(self, text: str) -> bytes:
        """Ids of a segment as little-endian 32-bit integers; a character that no piece has stands alone, as its bytes."""
        if self.characters.issuperset(text):
            return self._table(text)
        return b"".join(self._table("".join(run)) if known else b"".join(map(self._unknown, run)) for known, run in groupby(text, self.characters.__contains__))

    def _unknown(self, character: str) -> bytes:
        ids = [self.byte_id[b] for b in character.encode()] if self.byte_id else [self.unk]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _table(self, text: str) -> bytes:
        last: list[tuple | None] = [None] * len(text)  # of each prefix: id, length and bytes of its last token
        pairs = self.pairs
        for end, token in self.automaton.iter(text):
            if last[end] is not None:
                continue
            i, length, _ = token
            if length > end:
                last[end] = token
            elif (before := last[end - length]) is not None:
                key = before[0] << 20 | i
                fits = pairs.get(key)
                if fits or fits is None and self._compatible(key):
                    last[end] = token
        ids, i = [], len(text) - 1
        while i >= 0:
            _, length, coded = last[i]
            ids.append(coded)
            i -= length
        ids.reverse()
        return b"".join(ids)

    def encode_bytes(self, text: str, ends: bool = True) -> bytes:
        """Ids as little-endian 32-bit integers, with begin and end ids if asked for."""
        known = self.known
        parts = [self.bos.to_bytes(4, "little")] if ends else []
        if text:
            for segment in self.segments(SPACE + text.replace(" ", SPACE)):
                ids = known.get(segment)
                if ids is None:
                    if len(known) >= HELD:
                        known.clear()
                    ids = self._segment(segment)
                    if len(segment) <= 64:
                        known[segment] = ids
                parts.append(ids)
        if ends:
            parts.append(self.eos.to_bytes(4, "little"))
        return b"".join(parts)

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The UTF-8 text of ids: one leading space is the dummy prefix, and bytes that make no character become U+FFFD each."""
        piece = self.piece
        text = b"".join([piece[i] for i in ids])
        try:
            text.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        first = next((i for i in ids if piece[i]), None)
        return text[1:] if first is not None and first not in self.is_byte and text[:1] == b" " and piece[first][:1] == b" " else text

    def _decode_broken(self, ids: list[int]) -> bytes:
        out, run = [], b""
        for i in [*ids, -1]:
            if i in self.is_byte:
                run += self.piece[i]
                continue
            while run:
                for n in (4, 3, 2, 1):
                    try:
                        if len(run) >= n and len(run[:n].decode()) == 1:
                            out.append(run[:n])
                            break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�".encode())
                run = run[n:]
            if i >= 0:
                out.append(self.piece[i])
        return b"".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for each worker process and model."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode(docs: DataFrame, model_file: str, text: str = "text", ends: bool = True, out: str = "ids", round_trip: bool = False) -> DataFrame:
    """docs with the column `out`, array<int>, in place of any such column; null and empty texts have the end ids only.

    With round_trip there are also out_bytes (the ids as little-endian 32-bit integers) and out_text (their decoding),
    both binary, in place of the array. One pass over whole texts, without a shuffle; the model file is read by each
    worker from its own installation.
    """
    given = docs.select(*[f"`{c}`" for c in docs.columns if c not in (out, f"{out}_bytes", f"{out}_text")])
    at = given.columns.index(text)
    added = [(f"{out}_bytes", pa.binary(), "binary"), (f"{out}_text", pa.binary(), "binary")] if round_trip else [(out, pa.list_(pa.int32()), "array<int>")]
    schema = given
    for name, _, kind in added:
        schema = schema.withColumn(name, F.lit(None).cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        own = codec(model_file)
        for batch in batches:
            coded = [own.encode_bytes(x.as_py() or "", ends) for x in batch.column(at)]
            if round_trip:
                new = [pa.array(coded, pa.binary()), pa.array([own.decode_bytes(array.array("I", x)) for x in coded], pa.binary())]
            else:
                new = [pa.array([array.array("i", x) for x in coded], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[a[0] for a in added]])

    return given.mapInArrow(run, schema.schema)


def decode(df: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of an id array; null ids give null."""
    given = df.select(*[f"`{c}`" for c in df.columns if c != out])
    at = given.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = [None if x is None else own.decode_bytes(x).decode() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return given.mapInArrow(run, given.withColumn(out, F.lit("")).schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)



def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the text decoded from them, of all documents."""
    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), model_path(), round_trip=True)
    return coded.select(
        "doc_id", F.floor(F.length("ids_bytes") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("ids_text", 256).alias("decoded_sha256"),
    )
