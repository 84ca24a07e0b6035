"""Two tokenizers' tokens of the same bytes, aligned by byte-owner arrays.

Every byte of a text has an owner among tokenizer A's tokens and one among B's. Where either owner changes, the next pair
of owners overlaps; where both change at once, a group ends, and the tokens of a group are linked, each of A's with each
of B's. How many documents of the corpus hold a pair of ids linked is counted relationally over blocks of documents, whose
distinct pairs alone are joined to the count table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .pieces import SPACE, model_path
from .shared import documents, materialize
from .tokens import TextEncoder, tokenizer_path

#: Bytes of text after which a block of documents ends; links of a group up to which they are made one by one.
BLOCK_BYTES, FEW = 1 << 20, 256
#: Distinct words that a worker holds before it forgets those that it met once.
HELD = 300_000
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
#: Bits of B's id in the key of a pair, and of the whole key.
SHIFT, WIDE = 20, 40


class PlainEncoder(TextEncoder):
    """The encoder for which strings of special tokens are plain text."""

    def __init__(self, file: str):
        super().__init__(file)
        self.tokenizer.encode_special_tokens = True
        self.added = []


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


class _Bytes:
    """The bytes of each id's token in one buffer."""

    def spell(self, ids: np.ndarray) -> bytes:
        """What the tokens of ids spell."""
        length = self.length[ids]
        starts = np.cumsum(length) - length
        return self.buffer[np.repeat(self.offset[ids] - starts, length) + np.arange(length.sum())].tobytes()

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(x) for x in tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        #: An id as decimal digits followed by each separator.
        self.said = {end: np.array([f"{i}{end}".encode() for i in range(len(tokens))], object) for end in ",|;"}


class _Units:
    """Numbers, said groups and links of units of text, by place; links of all units lie in one array."""

    def __init__(self):
        self.numbers = np.empty((len(_NUMBERS), 0), np.int64)
        self.spelt = np.empty(0, bool)
        self.said: list[bytes] = []
        self.sizes = self.pairs = self.times = np.empty(0, np.int64)

    def extend(self, more: _Units) -> None:
        self.numbers, self.spelt, self.said = np.concatenate([self.numbers, more.numbers], axis=1), np.concatenate([self.spelt, more.spelt]), self.said + more.said
        self.sizes, self.pairs, self.times = (np.concatenate([getattr(self, c), getattr(more, c)]) for c in ("sizes", "pairs", "times"))

    def rows(self, places: np.ndarray) -> np.ndarray:
        """Where the links of the units at `places` lie, one after another."""
        size = self.sizes[places]
        begin = (np.cumsum(self.sizes) - self.sizes)[places]
        return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def pick(self, places: np.ndarray) -> _Units:
        made, rows = _Units(), self.rows(places)
        made.numbers, made.spelt, made.said, made.sizes = self.numbers[:, places], self.spelt[places], [self.said[i] for i in places.tolist()], self.sizes[places]
        made.pairs, made.times = self.pairs[rows], self.times[rows]
        return made


class Aligner:
    """Both tokenizers with the bytes of their tokens; one for each worker process.

    Neither tokenizer has a token that goes on over the begin of a word after a single space or line break, so texts
    whose white space is of that kind are aligned word by word, each distinct word once; others are aligned whole.
    """

    def __init__(self, tokenizer_file: str, model_file: str):
        import sentencepiece

        self.a, self.b = PlainEncoder(tokenizer_file), sentencepiece.SentencePieceProcessor(model_file=model_file)
        alphabet, vocabulary = byte_alphabet(), self.a.tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            entries[i] = bytes(alphabet[c] for c in entry)
        names = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.of_a, self.of_b = _Bytes(entries), _Bytes([bytes([int(name[1:-1], 16)]) if byte else name.replace(SPACE, " ").encode() for name, byte in names])
        if max(len(entries), len(names)) > 1 << SHIFT:
            raise ValueError("an id does not fit the key of a pair")
        self.mark = self.b.piece_to_id(SPACE)
        self.place: dict[str, int] = {}
        self.known, self.used = _Units(), np.empty(0, np.int64)

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
        """Ids by A and by B of all units, how many each unit has by either, their bytes, and the number of bytes of each.

        Units that begin with a space have B's own space there; before others it is taken off again. Units that the
        tokens do not spell have no tokens and no bytes.
        """
        data = [u.encode() for u in units]
        coded = self._words(units) if self._are_words(units) else self.a.encode(units)
        a, n_a = np.frombuffer(b"".join(coded), "<u4").astype(np.int64), np.array([len(x) // 4 for x in coded], np.int64)
        lists = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        lists = [x if u[0] == " " else x[1:] if x[:1] == [self.mark] else [0] for u, x in zip(units, lists, strict=True)]
        b, n_b = np.fromiter(chain.from_iterable(lists), np.int64), np.array([len(x) for x in lists], np.int64)
        n_bytes = np.array([len(x) for x in data], np.int64)
        whole, ok = b"".join(data), np.ones(len(units), bool)
        for ids, n, of in ((a, n_a, self.of_a), (b, n_b, self.of_b)):
            ends = np.concatenate([[0], np.cumsum(of.length[ids])])[np.cumsum(n)]
            spelt = of.spell(ids)
            if spelt != whole or (np.diff(ends, prepend=0) != n_bytes).any():
                ok &= [spelt[lo:hi] == raw for lo, hi, raw in zip([0, *ends[:-1].tolist()], ends.tolist(), data, strict=True)]
        if not ok.all():
            whole = b"".join(x for x, fine in zip(data, ok.tolist(), strict=True) if fine)
            a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        return a, np.where(ok, n_a, 0), b, np.where(ok, n_b, 0), whole, np.where(ok, n_bytes, 0)

    def _are_words(self, units: list[str]) -> bool:
        return self.a.even and not any(u[1:].split() != [u[1:]] for u in units)

    def _words(self, units: list[str]) -> list[bytes]:
        """A's ids of words, each after a space or a line break."""
        names = [u[1:] if u[0] == " " else u for u in units]
        self.a._learn_words(set(names))
        coded = list(map(self.a.words.__getitem__, names))
        self.a.words.clear()  # what is met again is known here
        return coded

    def units(self, texts: list[str]) -> _Units:
        """The alignment of each unit by itself: links are distinct, ascending by their key."""
        n, made = len(texts), _Units()
        a, n_a, b, n_b, _, n_bytes = self.tokens(texts)
        spelt = n_bytes > 0
        if not len(a):
            made.numbers, made.spelt, made.said, made.sizes = np.zeros((len(_NUMBERS), n), np.int64), spelt, [b""] * n, np.zeros(n, np.int64)
            return made
        owner_a, owner_b = (np.repeat(np.arange(len(ids), dtype=np.int32), of.length[ids]) for ids, of in ((a, self.of_a), (b, self.of_b)))
        unit_of_byte = np.repeat(np.arange(n), n_bytes)
        changed_a, changed_b = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (owner_a, owner_b))
        overlaps = np.bincount(unit_of_byte[changed_a | changed_b], minlength=n)
        starts = np.flatnonzero(changed_a & changed_b)  # of groups; the first token of a unit begins one, since all owners change there
        group_of_byte = np.cumsum(changed_a & changed_b) - 1
        group_a, group_b = group_of_byte[changed_a], group_of_byte[changed_b]
        unit_of_group = unit_of_byte[starts]
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        links = size_a * size_b
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, unit_of_group, links)

        # Links of small groups one by one; in others each distinct id of A with each of B, as often as they meet.
        first_b = np.cumsum(size_b) - size_b
        each = np.where(links <= FEW, size_b, 0)[group_a]
        left = np.repeat(np.arange(len(a)), each)
        right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first_b[group_a], each)
        keys, times = [unit_of_group[group_a[left]] << WIDE | a[left] << SHIFT | b[right]], [np.ones(len(left), np.int64)]
        first_a = np.cumsum(size_a) - size_a
        for g in np.flatnonzero(links > FEW).tolist():
            (ids_a, times_a), (ids_b, times_b) = (np.unique(x[s[g] : s[g] + m[g]], return_counts=True) for x, s, m in ((a, first_a, size_a), (b, first_b, size_b)))
            keys.append((int(unit_of_group[g]) << WIDE | ids_a[:, None] << SHIFT | ids_b[None, :]).ravel())
            times.append((times_a[:, None] * times_b[None, :]).ravel())
        key, made.times = _summed(np.concatenate(keys), np.concatenate(times))
        made.numbers = np.stack([n_a, n_b, np.bincount(unit_of_group, minlength=n), n_links, overlaps])
        made.spelt, made.sizes, made.pairs = spelt, np.bincount(key >> WIDE, minlength=n), key & ((1 << WIDE) - 1)
        made.said = self._say(a, b, group_a, group_b, size_a, size_b, n_a, n_b)
        return made

    def _say(self, a, b, group_a, group_b, size_a, size_b, n_a, n_b) -> list[bytes]:
        """The groups of each unit as `a1,a2|b1;a3|b2,b3`."""
        said = np.empty(len(a) + len(b), object)
        last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True]]) for g in (group_a, group_b))
        place_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]  # after all tokens of the groups before
        place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
        for place, ids, last, of, end in ((place_a, a, last_a, self.of_a, "|"), (place_b, b, last_b, self.of_b, ";")):
            said[place[last]], said[place[~last]] = of.said[end][ids[last]], of.said[","][ids[~last]]
        ends = np.cumsum(n_a + n_b).tolist()
        return [b"".join(said[lo:hi].tolist())[:-1] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Numbers of each text, and its distinct links: sizes (how many), pairs (keys, ascending within a text) and times."""
        if len(self.place) > HELD:  # words that were met again are kept, half of what may be held at most
            most = max(2, int(np.sort(self.used)[-(HELD // 2 + 1)]) + 1)
            keep = np.flatnonzero(self.used >= most)
            names = list(self.place)
            self.place = {names[i]: at for at, i in enumerate(keep.tolist())}
            self.known, self.used = self.known.pick(keep), np.zeros(len(keep), np.int64)
        parted, new, whole = [], [], []
        for text in texts:
            parts = text.replace("\n", " \n").split(" ") if text else []
            missing = set(parts).difference(self.place)
            if all(u.removeprefix("\n").split() == [u.removeprefix("\n")] for u in missing) and self.a.even:
                for u in missing:
                    self.place[u] = len(self.place)
                    new.append(u if u[0] == "\n" else f" {u}")
                parted.append(list(map(self.place.__getitem__, parts)))
            else:  # other white space: the text is a unit by itself
                parted.append([-1 - len(whole)])
                whole.append(f" {text}")
        if new:
            self.known.extend(self.units(new))
        known, held = self.known, len(self.place)
        if whole:
            known = _Units()
            known.extend(self.known)
            known.extend(self.units(whole))
            parted = [[held - 1 - x[0]] if x and x[0] < 0 else x for x in parted]
        n = len(texts)
        count = np.array([len(x) for x in parted], np.int64)
        flat, doc = np.fromiter(chain.from_iterable(parted), np.int64), np.repeat(np.arange(n), count)
        self.used = np.concatenate([self.used, np.zeros(held - len(self.used), np.int64)]) + np.bincount(flat[flat < held], minlength=held)
        spelt = np.ones(n, bool)
        spelt[doc[~known.spelt[flat]]] = False
        count, flat, doc = np.where(spelt, count, 0), flat[spelt[doc]], doc[spelt[doc]]
        numbers = [np.bincount(doc, x[flat], n).astype(np.int64) for x in known.numbers]
        sha = [hashlib.sha256(b";".join(map(known.said.__getitem__, x))).hexdigest() if x and fine else "" for x, fine in zip(parted, spelt.tolist(), strict=True)]
        row = known.rows(flat)
        key, times = _summed(np.repeat(doc, known.sizes[flat]) << WIDE | known.pairs[row], known.times[row])
        return dict(zip(_NUMBERS, numbers, strict=True)) | {"sha": sha, "sizes": np.bincount(key >> WIDE, minlength=n), "pairs": key & ((1 << WIDE) - 1), "times": times}


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their times."""
    if not len(key):
        return key, times
    order = np.argsort(key)
    key, times = key[order], times[order]
    once = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[once], np.add.reduceat(times, once)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(tokenizer_file: str, model_file: str) -> Aligner:
    key = (tokenizer_file, model_file)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _code(tokenizer_file: str, model_file: str, names: list[str], types: list[pa.DataType]):
    """Rows of (id, text) to blocks: numbers of each document, its distinct links by their place among the block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = aligner(tokenizer_file, model_file), zstandard.ZstdCompressor(level=3).compress
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, texts, size
            made = own.align(texts)
            pairs, place, held_by = np.unique(made["pairs"], return_inverse=True, return_counts=True)
            steps = np.diff(place, prepend=0)  # ascending within a document
            row = (block, ids, *[made[c] for c in _NUMBERS], made["sha"], made["sizes"], pairs, held_by, pack(np.concatenate([steps, made["times"]]).astype("<i8" if made["times"].max(initial=0) >> 31 else "<i4").tobytes()))
            block, ids, texts, size = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "") + 100
                if size >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return run


def _sum_up(names: list[str]):
    """Blocks with (pair, count, best) of all their pairs to the rows of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                ids, *numbers, sha, sizes, codes, parts = (batch.column(c)[row] for c in ("ids", *_NUMBERS, "sha", "sizes", "codes", "parts"))
                sizes = sizes.values.to_numpy().astype(np.int64)
                n, raw = int(sizes.sum()), unpack(codes.as_py())
                steps, times = np.frombuffer(raw, "<i8" if len(raw) == 16 * n else "<i4").astype(np.int64).reshape(2, n)
                best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                if n:
                    pair, count, top = (parts.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    order = np.argsort(pair)
                    place = np.cumsum(steps)
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    np.add.at(best, doc, times * top[order][place])
                    np.add.at(total, doc, times * count[order][place])
                columns = [ids.values, *[x.values for x in numbers], pa.array(best), pa.array(total), sha.values]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def align(docs: DataFrame, tokenizer_file: str, model_file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum and groups_sha256 of every row of docs.

    A encodes a space and the text, B the text, to which it adds the space itself; special tokens' strings are plain
    text. A pair of ids counts for each row that holds it linked, and count_sum adds the counts up over a row's links;
    n_best are those links whose count is the highest of their A id. groups_sha256 is the hash of the groups' ids.
    Null and empty texts, and those whose tokens of A or of B do not spell a space and the text, have no tokens: zeros
    and an empty string. Rows that repeat an id or a text stay rows and count each; other columns are not looked at,
    and an empty table gives an empty result.
    """
    kind = docs.select(F.col(f"`{id_column}`")).schema[0].dataType.simpleString()
    columns = {"block": "long", "ids": f"array<{kind}>"} | dict.fromkeys(_NUMBERS, "array<long>") | {"sha": "array<string>", "sizes": "array<int>", "pairs": "array<long>", "held_by": "array<int>", "codes": "binary"}
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [pa.list_(to_arrow_type(narrow.schema["id"].dataType)) if n == "ids" else pa.list_(arrow[t[6:-1]]) if t.startswith("array") else arrow[t] for n, t in columns.items()]
    shape = ", ".join(f"{n} {t}" for n, t in columns.items())
    coded = materialize(narrow.mapInArrow(_code(tokenizer_file, model_file, list(columns), types), shape), "aligned")
    pairs = coded.select("block", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("held_by").alias("held_by"))))
    counts = materialize(pairs.groupBy("pair").agg(F.sum("held_by").alias("count")), "pair_counts")
    of_a = F.shiftright("pair", SHIFT)
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("most"))  # at most as many pairs of an id as B has ids
    told = counts.withColumn("a", of_a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    met = pairs.select("block", "pair").join(told, "pair")
    gathered = met.groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("parts"))  # no more than a block's own pairs
    joined = coded.drop("pairs", "held_by").join(gathered, "block", "left")
    out = {"id": kind} | dict.fromkeys((*_NUMBERS, "n_best", "count_sum"), "long") | {"groups_sha256": "string"}
    return joined.mapInArrow(_sum_up(list(out)), ", ".join(f"{n} {t}" for n, t in out.items()))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of all documents; see align."""
    found = align(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path(), model_path())
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
