"""Media columns as interleaved document sequences: texts and media references in order, payloads joined by digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, free_names, materialize, new_path

#: Samples in a row of the stored picture; payloads are padded to a multiple of it.
ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png(samples: bytes, width: int = ROW) -> bytes:
    """A grey 8-bit PNG of `width` columns whose samples, row by row, are the bytes given."""
    if not samples or len(samples) % width:
        raise ValueError("the samples must fill whole rows")
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)  # each row begins with filter type 0
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 2)) + chunk(b"IEND", b"")


def samples(picture: bytes) -> bytes:
    """The bytes that png() was given; checksums are verified."""
    if picture[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(picture):
        (size,) = struct.unpack_from(">I", picture, at)
        kind, body = picture[at + 4 : at + 8], picture[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", picture, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged PNG")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64 bits in hex: whether each of 64 stretches of the payload is brighter than the whole."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    edges = np.arange(65) * len(x) // 64
    sums = np.add.reduceat(x, edges[:-1])
    return np.packbits(sums * len(x) > x.sum() * np.diff(edges)).tobytes().hex()


class _Sequence(HTMLParser):
    """Collects (kind, text, media, caption) in the order of the page."""

    BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer figure nav blockquote pre".split())
    SILENT = frozenset(("script", "style", "title", "noscript", "template"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.silent = 0
        self.figure: int | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag in self.SILENT:
            self.silent += 1
        if tag in self.BLOCKS:
            self.end_text()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.end_text()
            self.caption = []
        elif tag in ("img", "audio", "video", "source") and given.get("src"):
            self.end_text()
            self.items.append(["media", None, given["src"], given.get("alt") or None])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in self.BLOCKS:
            self.end_text()
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            media = [x for x in self.items[self.figure or 0 :] if x[0] == "media"]
            if caption and media:
                media[-1][3] = caption
            elif caption:
                self.items.append(["text", caption, None, None])
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[tuple]:
    """(position, kind, text, media, caption) of a page; captions are figcaption's text, else alt's."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end_text()
    return [(i, *x) for i, x in enumerate(parser.items)]


_FIELDS = ("position", "kind", "text", "media", "caption")
_ITEM = pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in _FIELDS[1:]]])
_ITEM_TYPE = "struct<position:int,kind:string,text:string,media:string,caption:string>"


def interleave(pages: DataFrame, html: str = "html", out: str = "items") -> DataFrame:
    """pages with the column `out` (array of structs in the page's order) in place of the HTML and of any such column.

    Null, empty and markup-free HTML give no items or one of text; repeated rows stay rows, and an empty table stays empty.
    """
    keep = [c for c in pages.columns if c not in (html, out)]
    (raw,) = free_names([*keep, out], "html")
    given = pages.select(*[f"`{c}`" for c in keep], F.col(f"`{html}`").alias(raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(_FIELDS, x, strict=True)) for x in sequence(h.as_py())] for h in batch.column(raw)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(_ITEM))], names=[*batch.schema.names[:-1], out])

    return given.mapInArrow(run, given.drop(raw).withColumn(out, F.lit(None).cast(f"array<{_ITEM_TYPE}>")).schema)


def padded(text: Column, row: int = ROW) -> Column:
    """A text with spaces up to a positive multiple of `row` bytes; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    size = F.octet_length(t)
    return F.concat(t, F.repeat(F.lit(" "), F.when(size == 0, row).otherwise(F.pmod(-size, F.lit(row)))))


def store(payloads: DataFrame, path: str, column: str = "payload") -> None:
    """Writes digest and media (the payload as a PNG) to the folder `path`: once for each distinct payload of a task.

    Stores are addressed by content, so an entry that several tasks write is the same one; an empty table gives an empty
    store. Payloads must be whole rows of the picture, as padded() makes them; null is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, media = [], []
            for x in batch.column(0):
                data = x.as_py().encode()
                digest = hashlib.sha256(data)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(png(data))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    payloads.select(F.col(f"`{column}`").alias("payload")).mapInArrow(run, "digest string, media binary").write.option("compression", "uncompressed").parquet(path)


_READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(spark: SparkSession, path: str) -> DataFrame:
    """What the stored bytes hold, one row for each digest; all is computed from what is read back.

    The rows are written to the shared folder, so that a join with them is a stage of its own, which Spark may split
    where very many pages show one medium.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_py()
                data = samples(media)
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    read = spark.read.schema("digest string, media binary").parquet(path).mapInArrow(run, _READ)
    return materialize(read.dropDuplicates(["digest"]), "described")


def explode_items(pages: DataFrame, items: str = "items", out: str = "item") -> DataFrame:
    """A row for each item of pages, with pages' other columns and the item as the struct `out`; pages without items have none."""
    given = [F.col(f"`{c}`") for c in pages.columns if c not in (items, out)]
    return pages.select(*given, F.explode(f"`{items}`").alias(out))


def resolve(rows: DataFrame, media: DataFrame, out: str = "item", prefix: str = "sha256:") -> DataFrame:
    """rows of media items (as explode_items gives them) whose struct `out` has a field payload: media's columns, joined by digest.

    media has a row for each digest. References of another kind and digests that media lacks keep a null payload, so no
    item is lost. Very many items of one digest are a skewed join, which Spark splits.
    """
    of, payload, known = free_names([*rows.columns, *media.columns], "of", "payload", "known")
    digest = F.when(F.col(f"{out}.media").startswith(prefix), F.substring(f"{out}.media", len(prefix) + 1, 1 << 20))
    held = media.select(F.col("digest").alias(known), F.struct(*[F.col(f"`{c}`") for c in media.columns if c != "digest"]).alias(payload))
    joined = rows.withColumn(of, digest).join(held, F.col(of) == F.col(known), "left")
    return joined.select(*[F.col(f"`{c}`") if c != out else F.col(out).withField("payload", F.col(payload)).alias(out) for c in rows.columns])


def sequences(pages: DataFrame, media: DataFrame, html: str = "html", out: str = "items", prefix: str = "sha256:") -> DataFrame:
    """interleave(pages) with payloads: each item of `out` has position, kind, text, media, caption and payload.

    Text items and items without a stored payload have null there; positions and captions are the page's. Pages without
    items have an empty array. Only media items go through the digest join; texts are gathered by their page's row.
    """
    (row,) = free_names([*pages.columns, out], "row")
    held = materialize(interleave(pages, html, out).withColumn(row, F.monotonically_increasing_id()), "interleaved")
    items = explode_items(held.select(row, out), out, "item")
    kind = resolve(items, media, prefix=prefix).schema["item"].dataType["payload"].dataType
    texts = items.filter("item.kind <> 'media'").withColumn("item", F.col("item").withField("payload", F.lit(None).cast(kind)))
    every = resolve(items.filter("item.kind = 'media'"), media, prefix=prefix).unionByName(texts)
    gathered = every.groupBy(F.col(row).alias("of")).agg(F.array_sort(F.collect_list("item"), lambda x, y: x["position"] - y["position"]).alias("found"))
    empty = F.array().cast(gathered.schema["found"].dataType)
    joined = held.join(gathered, F.col(row) == F.col("of"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in held.columns if c not in (row, out)], F.coalesce("found", empty).alias(out))


def illustrated(text: Column, digest: Column) -> Column:
    """A page of a text, a paragraph a line, with the picture of that digest after the first one, captioned by its digest's begin."""
    safe = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = lambda x: F.concat(F.lit("<p>"), F.replace(x, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    first = F.substring_index(safe, "\n", 1)
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('" alt="a picture"><figcaption>'), F.left(digest, F.lit(8)), F.lit("</figcaption></figure>"))
    return F.concat(paragraphs(first), figure, paragraphs(F.substring(safe, F.length(first) + 2, F.length(safe))))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and what the stored picture of its text holds, with the picture's place and caption in the document's page.

    The page shows the text around the picture. Its items are those of the sequence; texts stay where they are, and only
    the media items meet the store.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    payload, path = padded(F.col("text")), new_path(spark, "media")
    store(docs.select(payload.alias("payload")), path)
    pages = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), illustrated(F.col("text"), F.sha2(payload, 256)).alias("html"))
    shown = explode_items(interleave(pages)).filter("item.kind = 'media'")
    found = resolve(shown.withColumn("item", F.col("item").withField("text", F.lit(None).cast("string"))), describe(spark, path))
    return found.select("doc_id", "n_bytes", "item.payload.*", "item.position", "item.caption")
