"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

Every different text gets a signature of COORDINATES minima. It is posted under each (coordinate, value) pair; pairs that no other
text has cannot collide and fall away. Two texts of the wanted similarity agree in at least MATCHES coordinates but for a chance of
1.3 in a hundred thousand (at 0.85: 7 in a hundred million), so it is enough to meet under a prefix: a text's postings are ordered
by how common they are, and only the rarest ones, all but MATCHES - 1 of its coordinates, are joined. Values that very many texts
share stand last and are skipped by all texts that have enough else. Of the pairs met, the collisions over all coordinates are counted;
pairs with MATCHES of them at least are candidates, and these are confirmed on the full shingle sets.

A posting list of very many copies is not expanded into all its pairs. Its leader is the member whose coordinates are most common: in a
group of copies with small changes that is the text they come from, and all lists of the group have the same one. Lists with one leader
are one bucket, and first its members meet the leader alone. Only where a bucket then still spans several components, the members that
are not in the leader's one are compared with the others, blocks with blocks, each pair of blocks on its own, so that one large bucket
is dealt to as many tasks as it needs. Pairs within one component cannot add anything. So no link that could join two groups is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import batch_rows, fresh, materialise
from quarry.llm.components import components
from quarry.llm.words import NOT_SPACE, Words, batch_words, give_back, mix

COORDINATES, MATCHES = 48, 26
WORDS = 5
#: Similarity from which texts are linked, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Coordinates of the longer sketch, one byte each, and the agreements below which it rules the similarity out: the mean of two
#: texts at the similarity less five standard deviations. Only members of spread buckets get one.
SKETCH, SKETCH_MATCHES = 1024, 756
#: Texts handed to Python at a time: bounds a task's memory.
ROWS = 1000
#: Members of a bucket that make a block, a third of a megabyte.
BLOCK = 256
#: Bits for each text and most bits of the filter that says which texts a confirmation needs: beyond, it lets more texts pass.
FILTER_SHARE, FILTER_MOST = 16, 1 << 27

_A = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(101, COORDINATES + 101, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_SKETCH_A = (mix(np.arange(1001, 1001 + SKETCH, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SKETCH_B = (mix(np.arange(5001, 5001 + SKETCH, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ROW = mix(np.arange(11, 43, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SIGNED = "doc_id long, c1 long, c2 long, n_shingles long, signature binary"


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, borders, class hashes): each text's different shingles, sorted, where they start, and 2 x 64 bits of its words.

    A text of fewer words than a shingle has all its words as its only one; a text without words has none.
    """
    h, n = w.hashes(), np.diff(w.first)
    rows = np.arange(n.size)
    # Class: sums of words mixed with their places, in two independent ways.
    place = (np.arange(h.size) - np.repeat(w.first[:-1], n)).astype(np.uint64)
    classes = np.zeros((2, n.size), np.uint64)
    some = n > 0
    if h.size:
        for k in range(2):
            mixed = mix(h * _ROW[2 * k] + mix(place * _ROW[2 * k + 1] + np.uint64(k + 1)))
            classes[k, some] = np.add.reduceat(mixed, w.first[:-1][some])
    length = np.where(n >= size, n - size + 1, 0)
    row = np.repeat(rows, length)
    start = np.arange(row.size) - np.repeat(np.cumsum(length) - length, length) + w.first[:-1][row]
    s = np.zeros(row.size, np.uint64)
    for k in range(size):
        s = s * _ROW[5] + h[start + k] * _ROW[6 + k % 20] if row.size else s
    s = mix(s ^ np.uint64(size))
    short = np.flatnonzero(some & (n < size))
    if short.size:
        s = np.concatenate([s, classes[0, short] ^ np.uint64(0x5851F42D4C957F2D)])
        row = np.concatenate([row, short])
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    fresh = np.ones(s.size, bool)
    fresh[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[fresh], row[fresh]
    return s, np.searchsorted(row, np.arange(n.size + 1)), classes


def signatures(s: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """texts x COORDINATES minima, 32 bits each; zeros for an empty set."""
    out = np.zeros((borders.size - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(borders))
    if full.size:
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat(((s * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), borders[full])
    return out


def sketch(s: np.ndarray) -> bytes:
    """SKETCH further minima of one set, one byte of each."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    values = (s >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, values.size, 2048):
        part = values[lo : lo + 2048]
        np.minimum(low, (part[None, :] * _SKETCH_A[:, None] + _SKETCH_B[:, None]).min(axis=1), out=low)
    return (low & np.uint32(0xFF)).astype(np.uint8).tobytes()


def _binary(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() if v else None for r, v in zip(rows, valid.tolist())], pa.binary())


def sign(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, class of the text (c1, c2), n_shingles, signature (null for an empty set)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch_words(batch.column(1), NOT_SPACE):
                s, borders, classes = shingle_sets(w, words)
                n = np.diff(borders)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[w.lo : w.hi], pa.array(classes[0].view(np.int64)), pa.array(classes[1].view(np.int64)), pa.array(n.astype(np.int64)), _binary(signatures(s, borders), n > 0)],
                    names=["doc_id", "c1", "c2", "n_shingles", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(signed, SIGNED)


def post(classes: DataFrame) -> DataFrame:
    """(key, rep) for every coordinate of every signature; equal keys are equal coordinates with equal values."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            keys = (values | tag).reshape(-1).view(np.int64)
            reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps)], names=["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(posted, "key long, rep long")


def prefixes(postings: DataFrame) -> DataFrame:
    """(key, rep, common) of the rarest postings of each text that can meet another in MATCHES coordinates at all.

    common: how often the text's coordinates stand in other texts, all together.
    """
    shared_keys = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = postings.join(shared_keys, "key")
    mine = Window.partitionBy("rep")
    ranked = shared.select(
        "key", "rep", F.row_number().over(mine.orderBy("n", "key")).alias("rank"), F.count("*").over(mine).alias("left"), F.sum("n").over(mine).alias("common")
    )
    # Of all COORDINATES postings those that nobody shares are rarest, and already passed over.
    return ranked.where(F.col("rank") <= F.col("left") - (MATCHES - 1)).select("key", "rep", "common")


def buckets(met: DataFrame) -> DataFrame:
    """(leader, rep): members of the posting lists of two members at least, under the list's leader; the leader is a member, too."""
    leaders = met.groupBy("key").agg(F.count("*").alias("n"), F.min_by("rep", F.struct(-F.col("common"), F.col("rep"))).alias("leader")).where("n > 1")
    return met.select("key", "rep").join(materialise(leaders.select("key", "leader"), "leaders"), "key").select("leader", "rep").distinct()


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Packed rows of equal width as a table."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def colliding(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures collide in MATCHES coordinates at least. a may stand in very many pairs: it is joined last, so
    that its signature is never shuffled with them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (_rows(batch.column(k), np.uint32, COORDINATES) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((one == two).sum(axis=1) >= MATCHES))

    one, two = (classes.select(F.col("rep").alias(c), F.col("signature").alias(f"s{c}")) for c in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(counted, "a long, b long")


def across(members: DataFrame) -> DataFrame:
    """(a, b): pairs of members of one bucket in different components that collide in MATCHES coordinates and whose sketches leave the
    similarity possible.

    members: leader, rep, component, home (the leader's component), signature, sketch. Those outside the home component meet all others.
    Both kinds are dealt into blocks by hash; a pair of blocks is a row of its own, and pairs that are no candidates are never rows.
    """
    spark = members.sparkSession
    members = members.withColumn("out", F.col("component") != F.col("home"))
    blocks = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / BLOCK).cast("long")
    sizes = materialise(members.groupBy("leader").agg(blocks(F.col("out")).alias("outer"), blocks(~F.col("out")).alias("inner")), "sizes")
    n = F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))
    dealt = members.join(sizes, "leader").select("leader", "out", F.pmod(F.xxhash64("rep"), n).alias("block"), F.struct("rep", "component", "signature", "sketch").alias("member"))
    packed = materialise(dealt.groupBy("leader", "out", "block").agg(F.collect_list("member").alias("members")), "blocks")
    first = sizes.select("leader", "outer", "inner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)).alias("i"))
    others = F.concat(
        F.transform(F.sequence(F.col("i"), F.col("outer") - 1), lambda j: F.struct(F.lit(True).alias("out"), j.alias("block"))),
        F.when(F.col("inner") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("inner") - 1), lambda j: F.struct(F.lit(False).alias("out"), j.alias("block")))).otherwise(F.array()),
    )
    tasks = materialise(first.select("leader", "i", F.inline(others)), "tasks")
    one = packed.where("out").select("leader", F.col("block").alias("i"), F.col("members").alias("mi"))
    two = packed.select("leader", "out", "block", F.col("members").alias("mj"))

    def unpacked(rows: pa.Array, k: int) -> tuple[np.ndarray, ...]:
        m = rows[k].values
        return m.field(0).to_numpy(zero_copy_only=False), m.field(1).to_numpy(zero_copy_only=False), _rows(m.field(2), np.uint32, COORDINATES), _rows(m.field(3), np.uint8, SKETCH)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = [], []
                ra, ca, sa, ka = unpacked(batch.column(0), k)
                rb, cb, sb, kb = unpacked(batch.column(1), k)
                for x in range(ra.size):
                    maybe = np.flatnonzero(cb != ca[x])
                    maybe = maybe[(sb[maybe] == sa[x]).sum(axis=1) >= MATCHES]
                    maybe = maybe[(kb[maybe] == ka[x]).sum(axis=1) >= SKETCH_MATCHES]
                    if maybe.size:
                        left.append(np.full(maybe.size, ra[x]))
                        right.append(rb[maybe])
                if left:
                    a, b = np.concatenate(left), np.concatenate(right)
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["a", "b"])

    met = tasks.join(one, ["leader", "i"]).join(two, ["leader", "out", "block"]).select("mi", "mj")
    # A row is two whole blocks, so a batch holds few of them.
    with batch_rows(spark, 4):
        return materialise(met.mapInArrow(compared, "a long, b long"), "apart")


def _filter(ids: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words) of a Bloom filter of these ids: aggregated on the executors, its words come to the driver."""
    size = min(FILTER_MOST, max(1 << 16, 1 << (FILTER_SHARE * ids.count()).bit_length()))
    bits = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(size)) for k in range(3)])
    words = ids.select(F.explode(bits).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    out = np.zeros(size // 64, np.int64)
    for word, mask in words.toLocalIterator():
        out[word] = mask
    return size, out


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the documents in ids, and of few others: the full sorted set as 64-bit numbers."""
    spark = docs.sparkSession
    size, mask = _filter(ids)
    table = spark.sparkContext.broadcast(mask)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = table.value
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for k in range(3):
                at = batch.column(2 + k).to_numpy(zero_copy_only=False)
                hit &= (mask[at >> 6] >> (at & 63)) & 1 == 1
            wanted = batch.filter(pa.array(hit))
            for w in batch_words(wanted.column(1), NOT_SPACE):
                s, borders, _ = shingle_sets(w, words)
                sets = pa.array([s[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([wanted.column(0)[w.lo : w.hi], sets], names=["rep", "shingles"])

    hashed = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
        *[F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(k)), F.lit(size)).alias(f"h{k}") for k in range(3)],
    )
    return hashed.mapInArrow(cut, "rep long, shingles binary")


def sketches(sets: DataFrame) -> DataFrame:
    """(rep, sketch) of some sets."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(np.frombuffer(x.as_py(), np.uint64)) for x in batch.column(1)], pa.binary())], names=["rep", "sketch"])

    return sets.select("rep", "shingles").mapInArrow(drawn, "rep long, sketch binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. a may stand in very many pairs: it is joined last."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            one, two = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(one[k].as_py(), np.uint64), np.frombuffer(two[k].as_py(), np.uint64)
                small, large = (x, y) if x.size <= y.size else (y, x)
                if small.size * DENOMINATOR < large.size * NUMERATOR:
                    continue
                at = np.minimum(np.searchsorted(large, small), large.size - 1)
                both = int((large[at] == small).sum())
                good[k] = both * DENOMINATOR >= (x.size + y.size - both) * NUMERATOR
            yield batch.select(["a", "b"]).filter(pa.array(good))
        give_back()

    one, two = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    met = pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb")
    # A row holds two whole sets, of texts of any length.
    with batch_rows(pairs.sparkSession, 100):
        return materialise(met.mapInArrow(checked, "a long, b long").distinct(), "links")


def group(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Null and empty texts and texts without words have no shingles and are linked with nothing: component_id is their doc_id.
    Equal texts are one class and always linked if they have a word. Rows that repeat an id are one document: a link of any of
    them is a link of all. A null id gets the component of its class and is never kept. An empty table gives no row. Only doc_id
    and text are read. component_id is the least id that can be reached; kept is true for that document.
    """
    with batch_rows(docs.sparkSession, ROWS):
        signed = materialise(sign(docs, words), "signatures")
    # Exact copies fold into one class before anything is joined; the combiner does most of it ahead of the shuffle.
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    classes = materialise(classes, "classes")
    met = materialise(buckets(materialise(prefixes(post(classes)), "prefixes")), "buckets")
    first = materialise(colliding(met.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")), classes), "collisions")
    with batch_rows(docs.sparkSession, ROWS):
        sets = materialise(sets_of(docs, met.select(F.col("rep").alias("id")).distinct(), words), "sets")
    found = materialise(components(confirmed(first, sets)), "components")

    # Buckets that span several components: only pairs of different ones can still add anything.
    homes = found.select(F.col("node").alias("rep"), "component")
    placed = met.join(homes, "rep", "left").select("leader", "rep", F.coalesce("component", "rep").alias("component"))
    spread = placed.groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("rep") == F.col("leader"), F.col("component"))).alias("home")).where("lo < hi")
    members = materialise(placed.join(materialise(spread.select("leader", "home"), "spread"), "leader"), "members")
    drawn = materialise(sketches(sets.join(members.select("rep").distinct(), "rep", "left_semi")), "sketches")
    apart = across(members.join(classes.select("rep", "signature"), "rep").join(drawn, "rep"))
    more = confirmed(apart.distinct(), sets)

    joined = more.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = materialise(components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "merged")
    total = placed_components(found, merged).select(F.col("node").alias("rep"), "component")
    home = materialise(classes.select("c1", "c2", "rep").join(total, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component")), "homes")

    # A class of very many copies is split by the adaptive skew join: the other side has one row for it.
    whole = signed.select("doc_id", "c1", "c2", "n_shingles").join(home, ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def placed_components(found: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, component) after the components of `found` were joined as `merged` says; nodes new in `merged` are added."""
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
    moved = found.join(renamed, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    new = merged.join(found.select("node"), "node", "left_anti")
    return moved.unionByName(new)


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs, with their own columns whatever these are called, that are the kept one of their group.

    Rows that repeat an id are one document and stay or go together; rows without an id stay.
    """
    gone = fresh("_gone", docs.columns)
    drop = group(docs, words).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(materialise(drop, "gone"), F.col("doc_id").cast("long") == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
