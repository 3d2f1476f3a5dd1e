"""Product codes of vectors: each vector is cut into parts, each part is written as the number of its codebook's nearest entry.

Components become integers first, so sums, distances and ties are exact and depend on no partitioning. A round is one pass: every
task finds the nearest entry of each of its parts, adds up the parts of each entry, and Spark sums these partial sums; the driver
gets one number for each component of a codebook, whatever the number of vectors.

The codebooks are broadcast as kd-trees, one for each part: entries * dimension numbers, a bound that no input moves. Search is by
branch and bound, for many vectors at once: a node whose box is farther than the best entry so far is passed over; one exactly as
far is visited, since it may hold an entry of the same distance and a lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries in a leaf of a tree.
LEAF = 8
#: Vectors that are searched at a time.
BLOCK = 1 << 14
#: Labels whose sums are sent to all executors; more are joined by a shuffle.
MOST_LABELS = 100_000


@dataclass(frozen=True)
class Node:
    """A box of entries: its corners, and either two halves or, in a leaf, the entries in the order of their indexes."""

    low: np.ndarray
    high: np.ndarray
    axis: int = 0
    cut: int = 0
    halves: tuple[Node, Node] | None = None
    index: np.ndarray | None = None
    entries: np.ndarray | None = None


def kd_tree(entries: np.ndarray, index: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A tree over the rows of an integer matrix, halved along the widest side of each box."""
    index = np.arange(len(entries)) if index is None else index
    mine = entries[index]
    low, high = mine.min(axis=0), mine.max(axis=0)
    if len(index) <= leaf or not mine.shape[1]:
        order = np.sort(index)
        return Node(low, high, index=order, entries=entries[order])
    axis = int((high - low).argmax())
    order = index[np.argsort(mine[:, axis], kind="stable")]
    half = len(order) // 2
    return Node(low, high, axis, int(entries[order[half], axis]), (kd_tree(entries, order[:half], leaf), kd_tree(entries, order[half:], leaf)))


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of x; the lowest index of those equally near."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        mine = x[rows]
        gap = np.maximum(node.low - mine, 0) + np.maximum(mine - node.high, 0)
        near = (gap * gap).sum(axis=1) <= best[rows]
        rows, mine = rows[near], mine[near]
        if not rows.size:
            return
        if node.halves is None:
            apart = mine[:, None, :] - node.entries[None]
            apart = (apart * apart).sum(axis=2)
            first = apart.argmin(axis=1)  # the first of equals has the lowest index
            least, index = apart[np.arange(len(rows)), first], node.index[first]
            better = (least < best[rows]) | ((least == best[rows]) & (index < at[rows]))
            best[rows[better]], at[rows[better]] = least[better], index[better]
            return
        lower = mine[:, node.axis] < node.cut
        for order, some in ((node.halves, rows[lower]), (node.halves[::-1], rows[~lower])):
            for half in order:
                if some.size:
                    visit(half, some)

    visit(tree, np.arange(len(x)))
    return at, best


@dataclass(frozen=True)
class Codebooks:
    """Integer entries: an array of (part, entry, component). No vectors, no entries."""

    values: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, comma-joined, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Node]:
        return [kd_tree(part) for part in self.values]


def whole_vectors(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, ints: rows whose vector is there and holds finite numbers only, each as floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))  # NaN is above every number
    ints = F.transform(v, lambda x: F.floor(x * float(scale)).cast("bigint"))
    return vectors.where(F.col(vector).isNotNull() & finite).select("vec_id", "label", ints.alias("ints"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    lengths = pc.list_value_length(column).to_numpy()
    if (lengths != d).any():
        raise ValueError(f"a vector has {int(lengths[lengths != d][0])} components, the first one {d}")
    x = column.flatten().to_numpy().reshape(len(column), d)
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if d * (2 * most) ** 2 >= 1 << 63:
        raise ValueError(f"components of {most} are too large for distances of 64 bits")
    return x


def _blocks(batches: Iterator[pa.RecordBatch], trees: list[Node], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, parts, codes, distances) of runs of rows."""
    for whole in batches:
        for lo in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(lo, BLOCK)
            x = _matrix(batch.column("ints"), d)
            parts = x.reshape(len(x), len(trees), d // len(trees))
            found = [nearest(tree, np.ascontiguousarray(parts[:, p])) for p, tree in enumerate(trees)]
            yield batch, parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def fit(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the parts of the `entries` rows of least vec_id and are moved `rounds` times to their parts' floored means.

    ints: vec_id, ints (see whole_vectors), read once a round. Of rows with equal ids the least vector comes first; null ids come last.
    """
    first = [r[0] for r in ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()]  # at most `entries`
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    d = len(first[0])
    if d % parts or any(len(v) != d for v in first):
        raise ValueError(f"vectors need one length that {parts} parts divide, not {sorted({len(v) for v in first})}")
    values = np.array(first, np.int64).reshape(len(first), parts, d // parts).transpose(1, 0, 2)
    context = ints.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(Codebooks(values).trees())

        def partial(batches: Iterator[pa.RecordBatch], shared=shared, shape=values.shape) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
            for _, mine, codes, _ in _blocks(batches, shared.value, d):
                for p in range(shape[0]):
                    np.add.at(sums[p], codes[:, p], mine[:, p])
                    counts[p] += np.bincount(codes[:, p], minlength=shape[1])
            p, e = np.nonzero(counts)
            p, e, c = np.repeat(p, shape[2]), np.repeat(e, shape[2]), np.tile(np.arange(shape[2]), len(p))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(counts[p, e]), pa.array(sums[p, e, c])], ["part", "entry", "component", "n", "total"])

        sums = ints.select("ints").mapInArrow(partial, "part int, entry int, component int, n bigint, total bigint")
        moved = sums.groupBy("part", "entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # entries * d rows at most
        shared.destroy()
        values = values.copy()
        for r in moved:
            values[r["part"], r["entry"], r["component"]] = r["total"] // r["n"]
    return Codebooks(values)


def encode(ints: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances summed over parts), written to the shared folder."""
    schema = ints.select("vec_id", "label").schema
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", code string, error bigint"
    if not codebooks.values.size:
        return ints.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).where("false")
    d, digits = codebooks.values.shape[0] * codebooks.values.shape[2], np.array([f"{k:02x}" for k in range(256)], "S2")
    if codebooks.values.shape[1] > 256:
        raise ValueError("two digits name 256 entries at most")
    shared = ints.sparkSession.sparkContext.broadcast(codebooks.trees())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, apart in _blocks(batches, shared.value, d):
            text = np.ascontiguousarray(digits[codes]).tobytes()
            ends = np.arange(len(codes) + 1, dtype=np.int32) * (2 * codes.shape[1])
            code = pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(apart.sum(axis=1))], ["vec_id", "label", "code", "error"])

    out = materialise(ints.select("vec_id", "label", "ints").mapInArrow(coded, layout), "codes")
    shared.destroy()
    return out


def decode(codes: list[str], codebooks: Codebooks) -> pd.DataFrame:
    """The integer vectors that a few codes stand for; for reports and tests."""
    index = np.array([[int(c[k : k + 2], 16) for k in range(0, len(c), 2)] for c in codes])
    return pd.DataFrame({"code": codes, "vector": [codebooks.values[np.arange(len(i)), i].ravel().tolist() for i in index]})


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, most_labels: int = MOST_LABELS) -> DataFrame:
    """vec_id, code, error, label_error (error summed over rows of one label, null labels together), codebooks_sha256.

    Rows whose vector is null or holds a null or a number that is not finite are left out. Repeated rows are rows of their own and
    weigh as such. With fewer rows than entries the codebooks are smaller; no rows give no rows. Vectors of different lengths, or of
    a length that the parts don't divide, raise, as do components whose distances 64 bits can't hold. Other columns are not read.
    The sums of a hot label are made before they are shuffled, and its rows are joined with one row.
    """
    ints = whole_vectors(vectors, vector)
    books = fit(ints, parts, entries, rounds)
    coded = encode(ints, books)
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    small = F.broadcast(sums) if sums.count() <= most_labels else sums
    joined = coded.join(small, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
