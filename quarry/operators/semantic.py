"""Identifiers from a k-means tree over vectors: digits of the way down, then the place in the leaf.

Vectors become integers first, of so few bits that every sum of products is exact in 64-bit floats; draws are hashes of seed, restart,
step and document. So a node's clusters depend on its rows alone: not on their order, their partitions, or whether one task or all of
them cluster it. A level of the tree is made at once. A node of few rows, of a quarter of the table at most if that is large, is
finished by one task, with its whole subtree; for the larger ones each step is one pass over their rows for all nodes, restarts and
centres together, whose partial sums Spark adds up. Larger nodes are taken in waves of MOST_NODES, which bounds what the driver and a broadcast hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.ordinals import ORD, with_dense_order
from quarry.functions.vectors import l2_normalise
from quarry.storage import materialise

#: Rows of a node that one task clusters: a quarter of the table, but so many at least, and so many numbers at most (64 MB as floats).
#: The result does not depend on it. Larger nodes take a job for each step, however many there are.
NODE_ROWS, NODE_NUMBERS = 10_000, 1 << 23
#: Larger nodes that are clustered at once.
MOST_NODES = 500
#: Bits of a component, and of a sum of products.
BITS, EXACT_BITS = 20, 52
#: Bits by which distances are cut before they are summed.
INERTIA_SHIFT = 12
#: Rows of which distances are worked out at a time.
BLOCK = 1 << 13


def next_seed(seed: int, cluster: int) -> int:
    """A fixed value: the seed of a child."""
    return (seed * 1_000_003 + cluster + 97) % (1 << 32)


def noise(h: np.ndarray, *salts: int) -> np.ndarray:
    """Gumbel noise of each row, by a hash of its document's hash and the salts."""
    h = h.view(np.uint64)
    for salt in salts:
        h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93) % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)))


def draw(x: np.ndarray, h: np.ndarray, centres: np.ndarray | None, *salts: int) -> tuple[float, int, np.ndarray]:
    """(key, hash, row): a row drawn with the weight of its squared distance from the nearest centre, or any row if there is none.

    The row with the largest key is drawn, so the draw of many rows is the largest of the draws of their parts.
    """
    key = noise(h, *salts)
    if centres is not None:
        gap = np.concatenate([(_gaps(x[k : k + BLOCK], centres).min(axis=1) + (x[k : k + BLOCK] ** 2).sum(axis=1)) for k in range(0, len(x), BLOCK)])
        key = key + np.log(np.maximum(gap, 1e-300))
    first = np.lexsort((h, key))[-1]
    return float(key[first]), int(h[first]), x[first]


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the rows' own squares, exactly."""
    return (centres**2).sum(axis=1)[None] - 2 * (x @ centres.T)


def tally(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, rows, sums, inertia) by centre; of equally near centres the first has the row."""
    k, d = centres.shape
    labels, n, sums, inertia = np.empty(len(x), np.int64), np.zeros(k, np.int64), np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    for lo in range(0, len(x), BLOCK):
        mine = x[lo : lo + BLOCK]
        gaps = _gaps(mine, centres)
        label = gaps.argmin(axis=1)
        apart = (gaps[np.arange(len(mine)), label] + (mine**2).sum(axis=1)).astype(np.int64) >> INERTIA_SHIFT
        labels[lo : lo + BLOCK] = label
        chosen = np.zeros((k, len(mine)))
        chosen[label, np.arange(len(mine))] = 1.0
        n += np.bincount(label, minlength=k)
        inertia += (chosen @ apart).astype(np.int64)  # exact, too: a block has few rows
        sums += (chosen @ mine).astype(np.int64)
    return labels, n, sums, inertia


@dataclass
class Restart:
    """One clustering of one node on its way: centres, and what the last pass found with `used`."""

    centres: np.ndarray
    used: np.ndarray | None = None
    n: np.ndarray | None = None
    sums: np.ndarray | None = None
    inertia: int = 0
    settled: bool = False

    def moved(self, n: np.ndarray, sums: np.ndarray, inertia: int) -> list[int]:
        """Takes in a pass; returns the centres that lost their rows and have to be drawn anew. Settled if nothing has changed."""
        self.settled = self.n is not None and np.array_equal(n, self.n) and np.array_equal(sums, self.sums)
        self.used, self.n, self.sums, self.inertia = self.centres, n, sums, inertia
        if self.settled:
            return []
        full = n > 0
        means = (2 * sums + n[:, None]) // np.maximum(2 * n, 1)[:, None]
        self.centres = np.where(full[:, None], means, self.centres).astype(np.float64)
        return [int(c) for c in np.flatnonzero(~full)]


def cluster(x: np.ndarray, h: np.ndarray, k: int, seed: int, restarts: int, most_steps: int) -> np.ndarray | None:
    """Labels of the restart with the least inertia; None if all rows fall to one centre."""
    best: Restart | None = None
    for r in range(restarts):
        one = Restart(np.zeros((0, x.shape[1])))
        for c in range(k):
            one.centres = np.vstack([one.centres, draw(x, h, one.centres if c else None, seed, r, 0, c)[2]])
        for step in range(1, max(1, most_steps) + 1):
            _, n, sums, inertia = tally(x, one.centres)
            for c in one.moved(n, sums, int(inertia.sum())):
                one.centres[c] = draw(x, h, None, seed, r, step, c)[2]
            if one.settled:
                break
        if best is None or one.inertia < best.inertia:
            best = one
    return tally(x, best.used)[0] if (best.n > 0).sum() > 1 else None


@dataclass
class Large:
    """A node that all tasks cluster together."""

    prefix: str
    seed: int
    k: int
    restarts: list[Restart] = field(default_factory=list)

    def best(self) -> Restart:
        return min(self.restarts, key=lambda r: r.inertia)


_ROW = "docid string, o bigint, x array<int>, h bigint, prefix string, seed bigint"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, int, int]]:
    """(prefix, rows, hashes, lo, hi) of the runs of one prefix in a batch."""
    if not batch.num_rows:
        return
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
    h = batch.column("h").to_numpy()
    codes = pc.dictionary_encode(batch.column("prefix"))
    index, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
    edges = np.flatnonzero(np.diff(index)) + 1
    for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
        yield names[index[lo]], x[lo:hi], h[lo:hi], int(lo), int(hi)


def _drawn(rows: DataFrame, wanted: dict[str, list[tuple]]) -> dict[tuple[str, int, int], np.ndarray]:
    """The drawn row for each (prefix, restart, centre). wanted: by prefix, (restart, centre, centres or None, salts)."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], tuple] = {}
        for batch in batches:
            for prefix, x, h, _, _ in _runs(batch):
                for r, c, centres, salts in shared.value.get(prefix, ()):
                    now = draw(x, h, centres, *salts)
                    if (prefix, r, c) not in held or now[:2] > held[prefix, r, c][:2]:
                        held[prefix, r, c] = now
        if held:
            columns = [[k[0] for k in held], [k[1] for k in held], [k[2] for k in held], [v[0] for v in held.values()], [v[1] for v in held.values()], [v[2].astype(np.int32) for v in held.values()]]
            types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["prefix", "restart", "centre", "key", "h", "x"])

    found = rows.select("prefix", "x", "h").mapInArrow(local, "prefix string, restart int, centre int, key double, h bigint, x array<int>")
    best = found.groupBy("prefix", "restart", "centre").agg(F.max_by("x", F.struct("key", "h")).alias("x")).collect()  # a row for each draw
    shared.destroy()
    return {(r["prefix"], r["restart"], r["centre"]): np.array(r["x"], np.float64) for r in best}


def _passed(rows: DataFrame, centres: dict[str, dict[int, np.ndarray]], d: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray, int]]:
    """(rows, sums, inertia) by centre for each (prefix, restart): one pass, with partial sums as rows of (prefix, restart, centre)."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        for batch in batches:
            for prefix, x, _, _, _ in _runs(batch):
                for r, c in shared.value.get(prefix, {}).items():
                    now = tally(x, c)[1:]
                    held[prefix, r] = [a + b for a, b in zip(held[prefix, r], now)] if (prefix, r) in held else list(now)
        out: list[tuple] = [(p, r, c, int(n[c]), int(inertia[c]), sums[c]) for (p, r), (n, sums, inertia) in held.items() for c in np.flatnonzero(n)]
        if out:
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], t) for k, t in enumerate(types)], ["prefix", "restart", "centre", "n", "inertia", "total"])

    partial = rows.select("prefix", "x", "h").mapInArrow(local, "prefix string, restart int, centre int, n bigint, inertia bigint, total array<bigint>")
    sums = [F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(d)]
    found = partial.groupBy("prefix", "restart", "centre").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *sums).collect()  # a row for each centre
    shared.destroy()
    out = {(p, r): (np.zeros(len(c), np.int64), np.zeros((len(c), d), np.int64), 0) for p, by in centres.items() for r, c in by.items()}
    for row in found:
        n, totals, inertia = out[row["prefix"], row["restart"]]
        n[row["centre"]], totals[row["centre"]] = row["n"], row[5:]
        out[row["prefix"], row["restart"]] = n, totals, inertia + int(row["inertia"])
    return out


def _cluster_large(rows: DataFrame, nodes: list[Large], d: int, restarts: int, most_steps: int) -> None:
    """`cluster` for nodes that no task holds, all at once."""
    for node in nodes:
        node.restarts = [Restart(np.zeros((0, d))) for _ in range(restarts)]
    for c in range(max(node.k for node in nodes)):
        open_nodes = [node for node in nodes if c < node.k]
        wanted = {node.prefix: [(r, c, one.centres if c else None, (node.seed, r, 0, c)) for r, one in enumerate(node.restarts)] for node in open_nodes}
        found = _drawn(rows, wanted)
        for node in open_nodes:
            for r, one in enumerate(node.restarts):
                one.centres = np.vstack([one.centres, found[node.prefix, r, c]])
    for step in range(1, max(1, most_steps) + 1):
        moving = {node.prefix: {r: one.centres for r, one in enumerate(node.restarts) if not one.settled} for node in nodes}
        moving = {p: by for p, by in moving.items() if by}
        if not moving:
            break
        found, wanted = _passed(rows, moving, d), {}
        for node in nodes:
            for r in moving.get(node.prefix, {}):
                for c in node.restarts[r].moved(*found[node.prefix, r]):
                    wanted.setdefault(node.prefix, []).append((r, c, None, (node.seed, r, step, c)))
        if wanted:
            redrawn = _drawn(rows, wanted)
            for node in nodes:
                for r, c, _, _ in wanted.get(node.prefix, ()):
                    node.restarts[r].centres[c] = redrawn[node.prefix, r, c]


def _dealt(rows: DataFrame, nodes: list[Large]) -> DataFrame:
    """Rows of nodes that don't part, dealt round robin in document order: one range sort for all such nodes."""
    placed = with_dense_order(rows, ["prefix", "o", "docid"], "_n")
    starts = placed.groupBy("prefix").agg(F.min("_n").alias("_start"))
    table = rows.sparkSession.createDataFrame([(n.prefix, n.k, [next_seed(n.seed, c) for c in range(n.k)]) for n in nodes], "prefix string, _k int, _seeds array<bigint>")
    digit = ((F.col("_n") - F.col("_start")) % F.col("_k")).cast("int")
    joined = placed.join(F.broadcast(starts), "prefix").join(F.broadcast(table), "prefix").withColumn("_digit", digit)  # a row a node
    return joined.select("docid", "o", "x", "h", F.concat("prefix", F.col("_digit").cast("string")).alias("prefix"), F.element_at("_seeds", F.col("_digit") + 1).alias("seed"))


def _descended(rows: DataFrame, nodes: list[Large]) -> DataFrame:
    """Rows of parted nodes under their children's prefixes."""
    shared = rows.sparkSession.sparkContext.broadcast({n.prefix: (n.best().used, n.seed) for n in nodes})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, seeds = [], []
            for prefix, x, _, _, _ in _runs(batch):
                centres, seed = shared.value[prefix]
                labels = tally(x, centres)[0].tolist()
                prefixes += [f"{prefix}{c}" for c in labels]
                seeds += [next_seed(seed, c) for c in labels]
            columns = [batch.column(c) for c in ("docid", "o", "x", "h")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prefixes, pa.string()), pa.array(seeds, pa.int64())], ["docid", "o", "x", "h", "prefix", "seed"])

    return rows.mapInArrow(local, _ROW)


def _finish(branching: int, max_leaf: int, restarts: int, most_steps: int):
    """The whole subtree of a node that one task holds: old_docid, new_docid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "docid"], kind="stable")
        x, h, docids = np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["h"].to_numpy(np.int64), pdf["docid"].tolist()
        ids: list[tuple[str, str]] = []
        todo = [(np.arange(len(pdf)), pdf["prefix"].iloc[0], int(pdf["seed"].iloc[0]))]
        while todo:
            at, prefix, seed = todo.pop()
            if len(at) <= max_leaf:
                ids += [(docids[i], f"{prefix}{place}") for place, i in enumerate(at)]
                continue
            k = min(branching, len(at))
            labels = cluster(x[at], h[at], k, seed, restarts, most_steps)
            labels = np.arange(len(at)) % k if labels is None else labels
            todo += [(at[labels == c], f"{prefix}{c}", next_seed(seed, int(c))) for c in np.unique(labels)]
        return pd.DataFrame(ids, columns=["old_docid", "new_docid"])

    return run


def as_integers(vectors: DataFrame, normalise: bool) -> tuple[DataFrame, int]:
    """(docid, o, x, h) with components as integers of one scale, and their number.

    The scale is a power of two, such that a sum of all products of a pair of rows is exact.
    """
    v = F.col("vector").cast("array<double>")
    rows = vectors.select(F.col("docid").cast("string").alias("docid"), F.col(ORD).cast("bigint").alias("o"), (l2_normalise(v) if normalise else v).alias("v"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    found = rows.agg(F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("least"), F.max(largest).alias("largest"), F.count_if(F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x))).alias("bad")).first()
    if found["bad"] or (found["d"] or 0) != (found["least"] or 0):
        raise ValueError("every document needs a vector of one length without gaps")
    d = max(1, found["d"] or 1)
    bits = min(BITS, (EXACT_BITS - 2 - int(np.ceil(np.log2(d)))) // 2)
    exponent = bits - int(np.ceil(np.log2(found["largest"]))) if found["largest"] else 0
    x = F.transform("v", lambda c: F.round(c * float(2.0**exponent)).cast("int"))
    return rows.select("docid", "o", x.alias("x"), F.xxhash64("docid").alias("h")), d


def semantic_ids(
    vectors: DataFrame, branching: int = 10, max_leaf: int = 100, seed: int = 42, restarts: int = 4, most_steps: int = 100, normalise: bool = True,
    node_rows: int = 0, most_nodes: int = MOST_NODES, max_depth: int = 64,
) -> DataFrame:
    """old_docid, new_docid. vectors: docid (unique), _ord, vector.

    A node that doesn't part is dealt round robin in document order. A cluster that loses its rows is given one at random. Ids are
    unique because a branching above ten is refused. `node_rows` (0: by the table's size) and `most_nodes` say how the work is cut, not what comes out.
    """
    if not 2 <= branching <= 10 or max_leaf < 1:
        raise ValueError("branching lies between 2 and 10, and a leaf holds one document at least")
    start, d = as_integers(vectors, normalise)
    rows = start.withColumns({"prefix": F.lit(""), "seed": F.lit(seed).cast("bigint")})
    # Every step passes over all rows: deal them out once, however few files they came from.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    finish, done = _finish(branching, max_leaf, restarts, most_steps), None
    for _ in range(max_depth):
        rows = materialise(rows.sortWithinPartitions("prefix"), "tree")
        node_rows = node_rows or max(NODE_ROWS, min(rows.count() // 4, NODE_NUMBERS // d))
        sizes = rows.groupBy("prefix", "seed").agg(F.count("*").alias("n"))
        large = F.col("n") > max(node_rows, max_leaf)
        small = rows.join(sizes.where(~large).select("prefix"), "prefix", "left_semi")
        ready = small.groupBy("prefix").applyInPandas(finish, "old_docid string, new_docid string")
        done = ready if done is None else done.unionByName(ready)
        nodes = [Large(r["prefix"], r["seed"], min(branching, r["n"])) for r in sizes.where(large).orderBy("prefix").collect()]  # at most rows / node_rows
        if not nodes:
            return done
        below = None
        for lo in range(0, len(nodes), most_nodes):
            wave = nodes[lo : lo + most_nodes]
            mine = rows.where(F.col("prefix").isin([n.prefix for n in wave]))
            _cluster_large(mine, wave, d, restarts, most_steps)
            parted = [n for n in wave if (n.best().n > 0).sum() > 1]
            level = [_descended(mine.where(F.col("prefix").isin([n.prefix for n in parted])), parted)] if parted else []
            if stuck := [n for n in wave if n not in parted]:
                level.append(_dealt(mine.where(F.col("prefix").isin([n.prefix for n in stuck])), stuck))
            for part in level:
                below = part if below is None else below.unionByName(part)
        rows = below
    raise RuntimeError("the tree is deeper than it may be")
