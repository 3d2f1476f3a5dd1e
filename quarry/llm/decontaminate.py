"""Benchmark decontamination with a distributed positional inverted index.

`index` stores the postings of every word of the training documents. Documents are dealt to shards of bounded size; a shard is one row
with its terms, and for each term the sorted positions at which it stands. A shard holds whole documents, so a phrase never needs the
postings of two shards, no postings are shuffled, and the index serves any benchmark.

`search` sends the words of the benchmark, in blocks of bounded size, to all shards. A window of 13 words lives in a shard only if all
its terms do. Its terms are taken from the rarest one on: the rarest term's positions, moved by its offset in the window, are the starts
that are possible, and each further list, moved by its own offset, is intersected with what is left. With `slack`, a term may stand so
many words from its place.

Words are compared by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batch_rows, fresh, materialise, new_path
from quarry.llm.words import ALNUM, batch_words

WINDOW = 13
#: Words of benchmark items that are sent to the executors at a time, 8 bytes each (an item of more words is a block of its own).
BLOCK = 2_000_000
#: Starts of windows that a shard checks at a time: bounds a task's memory.
STARTS = 1 << 20
#: A document is contaminated if one word in so many is hit.
SHARE = 20

#: terms: sorted 64-bit hashes; first: where each term's positions begin; positions: 32 bits each, running through the shard's documents
#: with one place free behind each; base: where each document begins.
SHARD = "ids array<long>, keys array<long>, n_words array<long>, base binary, terms binary, first binary, positions binary"
MATCHES = "doc_id long, text_key long, item_id string, start long, length long"
HITS = "doc_id long, text_key long, spans array<struct<start:long,length:long>>, items array<string>"


def _packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def index(docs: DataFrame) -> DataFrame:
    """The index of docs, written to the shared folder: a row for each shard. Null texts are documents without words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch_words(batch.column(2), ALNUM):
                h = w.hashes()
                n = np.diff(w.first)
                base = w.first[:-1] + np.arange(n.size)
                order = np.argsort(h, kind="stable")
                position = np.arange(h.size) + np.repeat(np.arange(n.size), n)
                h = h[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.zeros(0, np.int64)
                whole = pa.array([0, n.size], pa.int32())
                lists = [pa.ListArray.from_arrays(whole, x) for x in (batch.column(0)[w.lo : w.hi], batch.column(1)[w.lo : w.hi], pa.array(n.astype(np.int64)))]
                rest = _packed(base.astype(np.int64), h[first], np.append(first, h.size).astype(np.int32), position[order].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([*lists, *rest], names=["ids", "keys", "n_words", "base", "terms", "first", "positions"])

    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    path = new_path(spark, "postings")
    # A row is about as large as its texts: few of them make a group of rows.
    rows.mapInArrow(cut, SHARD).write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(SHARD).parquet(path)


def text_key(text):
    """Tells apart texts of rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


@dataclass
class Asked:
    """Some items: their names, words (as numbers of `terms`, the sorted hashes), and windows (start, length, item)."""

    names: list[str]
    terms: np.ndarray
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, np.ndarray]]) -> Asked:
        n = np.array([h.size for _, h in items], np.int64)
        terms, words = np.unique(np.concatenate([h for _, h in items]), return_inverse=True)
        many = np.maximum(n - WINDOW + 1, 1)
        item = np.repeat(np.arange(n.size), many)
        place = np.arange(item.size) - np.repeat(np.cumsum(many) - many, many)
        return cls([name for name, _ in items], terms, words, (np.cumsum(n) - n)[item] + place, np.minimum(n, WINDOW)[item], item)


def blocks(items: DataFrame) -> Iterator[Asked]:
    """The benchmark in blocks of about BLOCK words; items without words have no window and fall away."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch_words(batch.column(1), ALNUM):
                h = w.hashes()
                own = [h[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[w.lo : w.hi], pa.array(own, pa.binary())], names=["item_id", "words"])

    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(hashed, "item_id string, words binary")
    held, size = [], 0
    for name, words in materialise(rows.where(F.octet_length("words") > 0).distinct(), "items").toLocalIterator():
        h = np.frombuffer(bytes(words), np.uint64)
        if held and size + h.size > BLOCK:
            yield Asked.of(held)
            held, size = [], 0
        held.append((name, h))
        size += h.size
    if held:
        yield Asked.of(held)


def _found(shard: dict, asked: Asked, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, starts) of the matches of asked windows in a shard."""
    terms, first = np.frombuffer(shard["terms"], np.uint64), np.frombuffer(shard["first"], np.int32).astype(np.int64)
    positions, base = np.frombuffer(shard["positions"], np.uint32).astype(np.int64), np.frombuffer(shard["base"], np.int64)
    if not terms.size:
        return
    place = np.minimum(np.searchsorted(terms, asked.terms), terms.size - 1)
    here = terms[place] == asked.terms
    lists = np.where(here, np.diff(first)[place], 0)[asked.words]
    missing = np.concatenate([[0], np.cumsum(lists == 0)])
    alive = np.flatnonzero(missing[asked.start + asked.length] == missing[asked.start])
    if not alive.size:
        return
    # All postings in one ordered row: the number of the term above, the position below.
    postings = (np.repeat(np.arange(terms.size), np.diff(first)) << 32) | positions

    def in_list(term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the term stands within slack of these places."""
        least = (term << 32) | np.maximum(at - slack, 0)
        k = np.minimum(np.searchsorted(postings, least), postings.size - 1)
        return (postings[k] >= least) & (postings[k] <= ((term << 32) | (at + slack))) & (at + slack >= 0)

    for length in np.unique(asked.length[alive]).tolist():
        same = alive[asked.length[alive] == length]
        for some in np.array_split(same, -(-same.size // (STARTS // 64))):
            words = asked.start[some][:, None] + np.arange(length)
            offsets = np.argsort(lists[words], axis=1, kind="stable")
            codes = place[asked.words[words]]
            rarest = codes[np.arange(some.size), offsets[:, 0]]
            n = first[rarest + 1] - first[rarest]
            edges = np.cumsum(n)
            lo = 0
            while lo < some.size:
                # As many windows as give STARTS starts, or one of more.
                hi = max(lo + 1, int(np.searchsorted(edges, (edges[lo - 1] if lo else 0) + STARTS, side="right")))
                mine, many = np.arange(lo, hi), n[lo:hi]
                row = np.repeat(mine, many)
                at = positions[np.repeat(first[rarest[lo:hi]] - (np.cumsum(many) - many), many) + np.arange(row.size)] - offsets[row, 0]
                for k in range(1, length):
                    good = in_list(codes[row, offsets[row, k]], at + offsets[row, k])
                    row, at = row[good], at[good]
                if slack and row.size:
                    # A match lies within one document, cut at its borders.
                    stop = base[np.searchsorted(base, at + offsets[row, 0], side="right") - 1]
                    at = np.maximum(at, stop)
                yield some[row], at
                lo = hi


def _each_block(shards: DataFrame, items: DataFrame, slack: int, put: Callable, schema: str, name: str) -> DataFrame:
    """The rows that put(shard, asked, windows and starts found) makes of every shard and block, written; a block is sent, searched
    and taken back before the next one."""
    spark = shards.sparkSession
    every = None
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for batch in batches:
                for k in range(batch.num_rows):
                    shard = {f: batch.column(f)[k].as_py() for f in ("base", "terms", "first", "positions")}
                    shard |= {f: batch.column(f)[k].values for f in ("ids", "keys", "n_words")}
                    yield from put(shard, asked, _found(shard, asked, slack))

        with batch_rows(spark, 16):
            found = materialise(shards.mapInArrow(look, schema), name)
        shared.destroy()
        every = found if every is None else every.unionByName(found)
    return spark.createDataFrame([], schema) if every is None else every


def search(shards: DataFrame, items: DataFrame, slack: int = 0) -> DataFrame:
    """doc_id, text_key, item_id, start, length of every match of a window of the items in an index.

    With slack 0 a match is a window that stands word for word; otherwise one whose terms all stand at most `slack` words from their
    places, counted from the rarest one. start is the window's first word in the document; length the words of the window.
    """

    def put(shard: dict, asked: Asked, matches: Iterator) -> Iterator[pa.RecordBatch]:
        base = np.frombuffer(shard["base"], np.int64)
        names = pa.array(asked.names, pa.string())
        for window, start in matches:
            doc = np.searchsorted(base, start, side="right") - 1
            found = np.unique(np.stack([doc, asked.item[window], start - base[doc], asked.length[window]], axis=1), axis=0)
            doc, item = pa.array(found[:, 0]), pa.array(found[:, 1])
            columns = [shard["ids"].take(doc), shard["keys"].take(doc), names.take(item), pa.array(found[:, 2]), pa.array(found[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "item_id", "start", "length"])

    return _each_block(shards, items, slack, put, MATCHES, "matches")


def hits(shards: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, spans, items of every document with a hit word: the runs of hit words and the items with occurring windows.

    Occurrences become runs in the shard that they are found in, so a document has a row for each block however often the items of
    the block stand in it; a row is no longer than its text.
    """

    def put(shard: dict, asked: Asked, matches: Iterator) -> Iterator[pa.RecordBatch]:
        base, n_words = np.frombuffer(shard["base"], np.int64), shard["n_words"].to_numpy(zero_copy_only=False)
        many = len(asked.names)
        edges = np.zeros((base[-1] + n_words[-1] + 1 if base.size else 0) + 1, np.int64)
        pairs = np.zeros(0, np.int64)
        for window, start in matches:
            np.add.at(edges, start, 1)
            np.subtract.at(edges, start + asked.length[window], 1)
            pairs = np.union1d(pairs, (np.searchsorted(base, start, side="right") - 1) * many + asked.item[window])
        if not pairs.size:
            return
        # A place is free behind each document, so no run goes from one into the next.
        hit = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        doc = np.searchsorted(base, start, side="right") - 1
        docs, first_span = np.unique(doc, return_index=True)
        first_item = np.searchsorted(pairs, docs * many)
        spans = pa.StructArray.from_arrays([pa.array(start - base[doc]), pa.array(stop - start)], names=["start", "length"])
        names = pa.array(asked.names, pa.string()).take(pa.array(pairs % many))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(f, len(v)).astype(np.int32)), v) for f, v in ((first_span, spans), (first_item, names))]
        yield pa.RecordBatch.from_arrays([shard["ids"].take(pa.array(docs)), shard["keys"].take(pa.array(docs)), *lists], names=["doc_id", "text_key", "spans", "items"])

    return _each_block(shards, items, 0, put, HITS, "hits")


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key for every row of docs.

    Null texts and texts without words have n_words 0 and are never contaminated; items without words have no window. Repeated rows
    get equal results, an empty documents table gives no row, an empty benchmark leaves every document clean. Equally rare terms are
    taken in the window's order, which changes no result. Only doc_id, text and item_id, text are read. Texts are read whole.
    """
    shards = index(docs)
    found = hits(shards, items)

    def add(so_far, span):
        fresh = F.greatest(F.lit(0), span["start"] + span["length"] - F.greatest(span["start"], so_far["at"]))
        return F.struct(F.greatest(so_far["at"], span["start"] + span["length"]).alias("at"), (so_far["n"] + fresh).alias("n"))

    # A document has a row for each block of the benchmark; those of repeated rows are equal.
    spans, names = F.array_sort(F.flatten(F.collect_set("spans"))), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    by_text = found.groupBy("doc_id", "text_key").agg(spans.alias("spans"), names.alias("items"))
    judged = materialise(by_text.select(
        F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.aggregate("spans", empty, add, lambda end: end["n"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"),
    ), "judged")
    rows = shards.select(F.inline(F.arrays_zip("ids", "keys", "n_words"))).toDF("doc_id", "text_key", "n_words")
    both = rows.join(judged, rows["doc_id"].eqNullSafe(judged["_d"]) & (rows["text_key"] == judged["_t"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"), "text_key",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns whatever these are called, whose text is not contaminated."""
    bad_id, bad_key = (fresh(n, docs.columns) for n in ("_bad_id", "_bad_key"))
    bad = judge(docs, items).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (text_key(F.col("text").cast("string")) == F.col(bad_key))
    return docs.join(materialise(bad, "contaminated"), same, "left_anti")
