"""Lines that many documents share, found with two Bloom filters and confirmed exactly.

A line's key is the line without white space at its ends, A-Z in lower case. Three passes over the texts:

1. Every task notes the filter positions of its lines' keys: those it saw in a document (once), and those it saw in two (twice). The
   tasks' filters are merged page by page, where a position that two of them saw once becomes one that was seen twice.
2. A key whose positions were all seen twice is suspected. Only suspected lines are shuffled: their keys are counted exactly, as
   texts, and their first occurrence is chosen, both with partial sums, so that a hot line is one row for each task.
3. Lines whose key was found in enough documents are dropped where they stand.

The twice filter is broadcast: 8 bits for each line of the corpus, at most MOST_BITS (64 MB). Beyond 500 million lines it fills up and
suspects ever more unique lines; the counts confirm them alike, at worst with every line shuffled once. The keys to be dropped travel
as 64-bit hashes, sorted, when there are at most MOST_KEYS of them; beyond that, suspected lines are joined with them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise
from quarry.llm.words import NOT_SPACE, _LOWER, give_back, hash_spans, mix, text_slices

#: Bits of a filter: 8 for each line, within these bounds.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29
#: Positions of a key.
PROBES = 2
#: Bits of a page, the unit in which filters are merged.
PAGE_BITS = 1 << 18
#: Positions that a task gathers before it hands pages on.
MOST_POSITIONS = 1 << 22
#: Keys whose hashes are broadcast: 32 MB.
MOST_KEYS = 1 << 22


class Lines:
    """The lines of a slice of texts: where each begins and ends, where its key does, and the key's hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        breaks = np.flatnonzero(data == 10)
        # A line begins where a text does and behind every line break.
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        # Behind a text's last break a line begins even if nothing follows; both it and the next text may begin at one place.
        per_text = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        self.text = np.repeat(np.arange(len(per_text)), per_text)
        ends = np.empty_like(self.starts)
        ends[:-1] = self.starts[1:] - 1
        last = self.first[1:] - 1
        ends[last] = offsets[1:]
        self.ends = ends
        marks = np.flatnonzero(NOT_SPACE[data])
        lo, hi = np.searchsorted(marks, self.starts), np.searchsorted(marks, self.ends)
        full = hi > lo
        self.key_starts, self.key_ends = self.starts.copy(), self.starts.copy()
        self.key_starts[full], self.key_ends[full] = marks[lo[full]], marks[hi[full] - 1] + 1
        self.full = np.flatnonzero(full)
        self.lower = _LOWER[data]
        self.hashes = np.zeros(len(self.starts), np.uint64)
        self.hashes[self.full] = hash_spans(self.lower, self.key_starts[self.full], self.key_ends[self.full])

    def key(self, k: int) -> bytes:
        return self.lower[self.key_starts[k] : self.key_ends[k]].tobytes()

    def each_once(self) -> np.ndarray:
        """Lines with a key, the first of each key in its text only."""
        order = self.full[np.lexsort((self.full, self.hashes[self.full], self.text[self.full]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.hashes[order[1:]] != self.hashes[order[:-1]]) | (self.text[order[1:]] != self.text[order[:-1]])
        return order[new]

    def without(self, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts without these lines; what stays is joined by one break."""
        kept = np.flatnonzero(~dropped)
        # A kept line brings the break before it along, but for the first that is kept of its text.
        again = np.zeros(len(kept), bool)
        again[1:] = self.text[kept[1:]] == self.text[kept[:-1]]
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, self.starts[kept] - again, 1)
        np.add.at(edge, self.ends[kept], -1)
        stays = np.cumsum(edge[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(stays)])
        return self.data[stays], sums[self.offsets]


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES filter positions of each hash, one row a probe."""
    return np.stack([mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(bits - 1) for k in range(1, PROBES + 1)])


def filter_bits(n_lines: int) -> int:
    """A power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, BITS_PER_LINE * n_lines)))))


_PAGES = "page int, salt int, once binary, twice binary"


def _packed(page: int, salt: int, once: np.ndarray, twice: np.ndarray) -> tuple:
    return page, salt, zlib.compress(np.packbits(once).tobytes(), 1), zlib.compress(np.packbits(twice).tobytes(), 1)


def _opened(body: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(body), np.uint8)).astype(bool)


def twice_filter(docs: DataFrame, bits: int) -> np.ndarray:
    """The filter of what was seen in two documents, packed: the tasks' filters are merged in two levels, so that no group grows with
    more than the square root of the tasks' number."""
    page_bits = min(bits, PAGE_BITS)
    tasks = docs.rdd.getNumPartitions()
    salts = max(1, math.isqrt(tasks))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        salt, held, n = TaskContext.get().partitionId() % salts, [], 0

        def pages() -> Iterator[tuple]:
            # Each document brought a position once; what several brought was seen twice.
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            of = found // page_bits
            for page in np.unique(of):
                mine = of == page
                once, twice = np.zeros(page_bits, bool), np.zeros(page_bits, bool)
                once[found[mine] % page_bits] = True
                twice[found[mine & (counts > 1)] % page_bits] = True
                yield _packed(int(page), salt, once, twice)

        def rows(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.binary()), pa.array([m[3] for m in made], pa.binary())], ["page", "salt", "once", "twice"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                lines = Lines(data, offsets)
                at = lines.each_once()
                where = positions(lines.hashes[at], bits).astype(np.int64)
                # A document counts once for a position, however many of its keys have it.
                pairs = np.unique(np.concatenate([where[k] + lines.text[at].astype(np.int64) * bits for k in range(PROBES)])) if at.size else where[0]
                held.append((pairs % bits).astype(np.uint32))
                n += len(pairs)
                if n >= MOST_POSITIONS:
                    yield rows(list(pages()))
                    held, n = [], 0
        if n:
            yield rows(list(pages()))

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(page_bits, bool), np.zeros(page_bits, bool)
        for a, b in zip(group["once"], group["twice"]):
            a = _opened(a)
            twice |= _opened(b) | (once & a)
            once |= a
        return pd.DataFrame([_packed(int(group["page"].iloc[0]), 0, once, twice)], columns=["page", "salt", "once", "twice"])

    local = docs.select("text").mapInArrow(seen, _PAGES)
    rows = local.groupBy("page", "salt").applyInPandas(merged, _PAGES).groupBy("page").applyInPandas(merged, _PAGES).select("page", "twice").collect()  # bits / 8 bytes at most
    out = np.zeros(bits // 8, np.uint8)
    for page, twice in rows:
        out[page * page_bits // 8 : (page + 1) * page_bits // 8] = np.frombuffer(zlib.decompress(twice), np.uint8)
    return out


def _in_filter(filled: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    inside = np.ones(len(hashes), bool)
    for where in positions(hashes, bits).astype(np.int64):
        inside &= (filled[where >> 3] >> (7 - (where & 7)).astype(np.uint8) & 1).astype(bool)
    return inside


def suspects(docs: DataFrame, filled: np.ndarray, bits: int) -> DataFrame:
    """doc_id, line (1, 2, ...), hash, key: the first line of each suspected key in each document."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)
    kept = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column("text")):
                lines = Lines(data, offsets)
                at = lines.each_once()
                at = at[_in_filter(shared.value, lines.hashes[at], bits)]
                ids = batch.column("doc_id").take(pa.array(lo + lines.text[at]))
                place = at - lines.first[lines.text[at]] + 1
                keys = _strings(lines.lower, lines.key_starts[at], lines.key_ends[at])
                yield pa.RecordBatch.from_arrays([ids, pa.array(place), pa.array(lines.hashes[at].view(np.int64)), keys], ["doc_id", "line", "hash", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kept}, line bigint, hash bigint, key string")


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string column of spans."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])


_RESULT = "n_lines bigint, n_dropped bigint, kept string"


def _emptied(batch: pa.RecordBatch, choose) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with n_lines, n_dropped and the text that stays; choose(lines, lo) says which lines go."""
    for lo, hi, data, offsets in text_slices(batch.column("text")):
        lines = Lines(data, offsets)
        gone = choose(lines, lo)
        left, ends = lines.without(gone)
        n_lines = np.diff(lines.first)
        n_gone = np.add.reduceat(gone.astype(np.int64), lines.first[:-1])
        kept = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(left.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n_lines), pa.array(n_gone), kept], ["doc_id", "n_lines", "n_dropped", "kept"])


def _by_hash(docs: DataFrame, hashes: np.ndarray, firsts: tuple | None, mixed: dict[int, frozenset[bytes]]) -> DataFrame:
    """Lines dropped by the sorted hashes of their keys; `mixed` has the keys of hashes that a key which stays shares."""
    shared = docs.sparkSession.sparkContext.broadcast((hashes, firsts, mixed))
    kept = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, firsts, mixed = shared.value
        for batch in batches:
            ids = [str(i) for i in batch.column("doc_id").to_pylist()] if firsts else []

            def choose(lines: Lines, lo: int) -> np.ndarray:
                gone = np.zeros(len(lines.starts), bool)
                if not hashes.size:
                    return gone
                mine = lines.hashes[lines.full].view(np.int64)
                at = np.minimum(np.searchsorted(hashes, mine), hashes.size - 1)
                gone[lines.full] = hashes[at] == mine
                for k in np.flatnonzero(gone) if mixed or firsts else ():
                    h = int(lines.hashes[k].view(np.int64))
                    if h in mixed:
                        gone[k] = lines.key(k) in mixed[h]
                    if gone[k] and firsts:
                        place = int(np.searchsorted(hashes, h))
                        t = int(lines.text[k])
                        gone[k] = (firsts[0][place], firsts[1][place]) != (ids[lo + t], k - lines.first[t] + 1)
                return gone

            yield from _emptied(batch, choose)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kept}, {_RESULT}")


def _by_join(docs: DataFrame, filled: np.ndarray, bits: int, dropped: DataFrame, keep_first: bool) -> DataFrame:
    """The same for any number of keys: rows get a number, suspected lines meet the dropped keys, and rows their dropped keys' hashes.

    A row of the join's result holds what one document loses, so no group is larger than a document.
    """
    numbered = materialise(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    lines = suspects(numbered.select(F.col("_row").alias("doc_id"), "text"), filled, bits).withColumnRenamed("doc_id", "_row")
    lost = lines.join(dropped.select("key", "_doc", "_line"), "key")
    if keep_first:
        ids = numbered.select("_row", F.col("doc_id").cast("string").alias("_id"))
        lost = lost.join(ids, "_row")
        first = (F.col("_id").eqNullSafe(F.col("_doc"))) & (F.col("line") == F.col("_line"))
    else:
        first = F.lit(False)
    per_row = lost.groupBy("_row").agg(F.collect_list(F.struct("key", F.when(first, F.col("line")).otherwise(F.lit(0).cast("bigint")).alias("stays"))).alias("_lost"))
    rows = numbered.join(per_row, "_row", "left").select("doc_id", "text", "_lost")
    kept = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column("_lost")

            def choose(lines: Lines, lo: int) -> np.ndarray:
                gone = np.zeros(len(lines.starts), bool)
                for t in range(len(lines.first) - 1):
                    if lost[lo + t].is_valid:
                        keys = {x["key"].encode(): x["stays"] for x in lost[lo + t].as_py()}
                        for k in range(lines.first[t], lines.first[t + 1]):
                            gone[k] = keys.get(lines.key(k), k - lines.first[t] + 1) != k - lines.first[t] + 1
                return gone

            yield from _emptied(batch, choose)

    return rows.mapInArrow(run, f"doc_id {kept}, {_RESULT}")


def drop_repeated(docs: DataFrame, min_documents: int = 10, keep: str = "none", most_keys: int = MOST_KEYS, bits: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays): one row for each row of docs.

    Lines whose key, of one character at least, stands in `min_documents` rows of docs or more go: all of them, or with keep="first"
    all but the first line that has it in the row of least doc_id. A row is a document, so repeated rows count as often as they come.
    A null or empty text is one empty line, which has no key; blank lines have none either. A text that loses all lines is empty. An
    empty table gives an empty one. Other columns are not read. A task holds a few arrays over 1 MB of text or over one longer text.
    """
    if min_documents < 2:
        raise ValueError("a line repeats in two documents at least")
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    n_lines = docs.agg(F.coalesce(F.sum(F.coalesce(breaks, F.lit(0)) + 1), F.lit(0))).first()[0]
    bits = bits or filter_bits(n_lines)
    filled = twice_filter(docs, bits)
    found = suspects(docs, filled, bits)
    first = F.min(F.struct("doc_id", "line")).alias("_first")
    counted = materialise(found.groupBy("key").agg(F.count("*").alias("n"), F.min("hash").alias("hash"), first), "suspected-lines")
    goes = F.col("n") >= min_documents
    dropped = counted.where(goes).select("key", "hash", F.col("_first.doc_id").cast("string").alias("_doc"), F.col("_first.line").alias("_line"))
    if dropped.count() > most_keys:
        return _by_join(docs, filled, bits, dropped, keep == "first")
    # A key that stays can share its hash with one that goes only if it was suspected, too.
    mixed = counted.groupBy("hash").agg(F.bool_or(goes).alias("any"), F.bool_and(goes).alias("all"), F.count_if(goes).alias("n")).where("any and (not all or n > 1)")
    clash = mixed.select("hash").collect()  # pairs of lines with one 64-bit hash among the suspected: hardly any
    exact: dict[int, set[bytes]] = {}
    if clash:
        for r in dropped.where(F.col("hash").isin([c[0] for c in clash])).select("hash", "key").collect():
            exact.setdefault(r[0], set()).add(r[1].encode())
    if clash and keep == "first":
        return _by_join(docs, filled, bits, dropped, True)
    columns = ["hash", "_doc", "_line"] if keep == "first" else ["hash"]
    table = dropped.select(*columns).toPandas().drop_duplicates("hash").sort_values("hash")
    firsts = ([str(d) for d in table["_doc"]], table["_line"].to_numpy()) if keep == "first" else None
    return _by_hash(docs, table["hash"].to_numpy().astype(np.int64), firsts, {h: frozenset(k) for h, k in exact.items()})


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
