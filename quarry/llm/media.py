"""Media columns and interleaved document sequences.

`parse_sequences` turns HTML into an ordered array of structs, text and media references alternating as on the page, each reference
with its position, digest and caption. `store_payloads` writes payloads losslessly as 8-bit mono PCM sound files into a table in
the shared folder, and `describe` reads the stored bytes back and computes their features. `resolve` joins references and stored
payloads by digest and puts every sequence together again in its order, captions beside their media.

Payload bytes cross no shuffle: they are written once where they are made, and only digests and descriptions are joined.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, new_path

#: A payload's size is a positive multiple of this.
UNIT = 64
SAMPLE_RATE = 8000
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")

ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
SEQUENCE = f"doc_id long, row_key long, items array<{ITEM}>"
DESCRIPTION = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_ITEM_ARROW = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def payload(text: Column) -> Column:
    """UTF-8 bytes with zero bytes up to a positive multiple of UNIT; a null is an empty text."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    missing = F.when(F.octet_length(raw) == 0, F.lit(UNIT)).otherwise(F.pmod(-F.octet_length(raw), F.lit(UNIT))).cast("int")
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), missing)))


def to_sound(samples: bytes) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    if len(samples) + 36 >= 1 << 32:
        raise ValueError("a payload of 4 GB or more does not fit this format")
    return _HEADER.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(samples)) + samples


def from_sound(stored: bytes) -> bytes:
    head = _HEADER.unpack_from(stored)
    size = head[-1]
    if (head[0], head[2], head[10], len(stored)) != (b"RIFF", b"WAVE", 8, _HEADER.size + size):
        raise ValueError("not a stored payload")
    return stored[_HEADER.size :]


def feature(samples: bytes) -> str:
    """Number, sum and sum of squares of the samples, changes of side of the middle, and a histogram of 16 steps; whole numbers."""
    s = np.frombuffer(samples, np.uint8)
    counts = np.bincount(s, minlength=256)
    value = np.arange(256)
    upper = s >= 128
    flips = int(np.count_nonzero(upper[1:] != upper[:-1]))
    steps = ",".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))
    return f"n={s.size};sum={int(counts @ value)};squares={int(counts @ value**2)};flips={flips};steps={steps}"


def store_payloads(payloads: DataFrame) -> DataFrame:
    """Write (digest, payload) rows as sound files and return the stored table (digest, media).

    Rows that repeat a digest are stored as often as they come; readers take one of them.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                part = raw[lo : lo + 256].to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 256], pa.array([to_sound(p) for p in part], pa.binary())], names=["digest", "media"])

    stored = payloads.select("digest", "payload").mapInArrow(encoded, "digest string, media binary")
    spark = payloads.sparkSession
    path = new_path(spark, "media")
    stored.write.option("compression", "zstd").parquet(path)
    return spark.read.schema("digest string, media binary").parquet(path)


def describe(store: DataFrame) -> DataFrame:
    """Read stored payloads back: one row of sizes, checksums and features for each digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0), batch.column(1)):
                media = media.as_py()
                samples = from_sound(media)
                rows.append((digest.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    # Rows of a digest are equal, so the first of any column will do; the combiner folds copies before the shuffle.
    rows = store.mapInArrow(read, DESCRIPTION)
    return rows.groupBy("digest").agg(*[F.min(c).alias(c) for c in rows.columns[1:]])


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SPACE = re.compile(r"\s+")


def parse_sequence(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """The page's items in order: ('text', its words) and ('media', digest, caption).

    A reference names its payload by `media:<digest>` in src, or by data-digest. Its caption is that of the figure around it, else
    its alt text. Markup, comments, scripts and styles leave nothing. A null or empty page has no items.
    """
    items: list[list] = []
    words: list[str] = []
    caption: list[str] | None = None
    figure: list[list] = []
    in_figure = False

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        words.clear()
        if text:
            items.append([len(items), "text", text, None, None])

    def say(text: str) -> None:
        (words if caption is None else caption).append(text)

    at = 0
    for m in _TOKEN.finditer(page or ""):
        say(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        closing, tag = bool(m[2]), m[3].lower()
        if tag in _MEDIA and not closing:
            given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[4])}
            source = given.get("src", "")
            digest = given.get("data-digest") or (source[6:] if source.startswith("media:") else None)
            if digest or source:
                if caption is None:
                    flush()
                item = [len(items), "media", None, digest or source, given.get("alt")]
                items.append(item)
                if in_figure:
                    figure.append(item)
        elif tag == "figure":
            in_figure = not closing
            figure.clear()
        elif tag == "figcaption":
            if not closing:
                flush()
                caption = []
            elif caption is not None:
                text = _SPACE.sub(" ", html.unescape("".join(caption))).strip()
                for item in figure:
                    item[4] = text
                caption = None
        elif caption is None and tag in {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section"}:
            words.append("\n")
    say((page or "")[at:])
    if caption is not None:
        words.extend(caption)
    flush()
    return [tuple(i) for i in items]


def parse_sequences(pages: DataFrame, id_column: str = "doc_id", html_column: str = "html") -> DataFrame:
    """(doc_id, row_key, items) of each page; row_key tells repeated rows apart."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[dict(zip(("position", "kind", "text", "digest", "caption"), i)) for i in parse_sequence(p)] for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(_ITEM_ARROW))], names=["doc_id", "row_key", "items"])

    rows = pages.select(F.col(id_column).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(parsed, SEQUENCE)


def resolve(sequences: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Every item of every sequence with what its digest resolves to: doc_id, row_key, position, kind, text, caption, digest and the
    columns of `descriptions` (null for text and for a digest that is not stored).

    References are joined by digest; a digest that very many rows name is split by the adaptive skew join, as the other side is a
    written table with one row for it.
    """
    # Written once: both branches below have to see the same row keys.
    items = materialise(sequences.select("doc_id", "row_key", F.inline("items")), "items")
    texts = items.where(F.col("kind") == "text")
    media = items.where(F.col("kind") == "media").join(materialise(descriptions, "descriptions"), "digest", "left")
    return media.unionByName(texts, allowMissingColumns=True)


def gather(items: DataFrame) -> DataFrame:
    """Sequences again, one row each: doc_id, row_key and the items in their order."""
    columns = [c for c in items.columns if c not in ("doc_id", "row_key")]
    ordered = F.array_sort(F.collect_list(F.struct("position", *[c for c in columns if c != "position"])), lambda a, b: a["position"] - b["position"])
    return items.groupBy("doc_id", "row_key").agg(ordered.alias("items"))


def document_media(docs: DataFrame) -> DataFrame:
    """Every document's text as a stored payload, referred to by an interleaved page of its own and resolved by digest.

    One row for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    position, caption. A null text is an empty one, whose payload is 64 zero bytes. Equal texts get equal values, repeated rows
    stay repeated, an empty table gives no row, other columns are not read.
    """
    text = F.col("text").cast("string")
    stored = docs.select(F.sha2(payload(text), 256).alias("digest"), payload(text).alias("payload"))
    descriptions = describe(store_payloads(stored))
    n_bytes = F.octet_length(F.coalesce(text, F.lit(""))).cast("string")
    page = F.concat(F.lit('<article><figure><img src="media:'), F.sha2(payload(text), 256), F.lit('"><figcaption>'), n_bytes, F.lit("</figcaption></figure></article>"))
    sequences = parse_sequences(docs.select(F.col("doc_id"), page.alias("html")))
    found = resolve(sequences, descriptions).where(F.col("kind") == "media")
    return found.select(
        "doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32",
        "media_bytes", "media_sha256", "feature", "position", "caption",
    )
