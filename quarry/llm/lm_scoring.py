"""Language-model scores by masked pseudo-likelihood.

A bidirectional window network predicts every word of a text from the two words on either side: position tables feed a hidden layer,
which feeds a softmax over word classes in two steps, first the group of the class, then the class in its group. The most frequent
words are classes of their own, the others share classes by hash; both kinds grow with the square root of the number of different
words. Within a shared class a word has its share of the corpus count. The score of a document is the sum of the logarithms of
these conditional probabilities over all its words.

Everything is gathered from all documents, and no result depends on how they are partitioned. Words are counted by their 64-bit hashes
in a table of the shared folder, one row a word (two of a billion words share a hash with a chance of 3 %). The most frequent words,
a bounded number, are sent to all tasks with their counts; those of all others are joined. Documents are written once as numbers of
classes. They are dealt by hash into groups of a size that follows from the corpus, and each group, in the order of its hashes, trains a
network by gradient descent in numpy, with every word as a target once; the weights are averaged by the words behind them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batch_rows, materialise, new_path
from quarry.llm.words import NOT_SPACE, batch_words

#: Least numbers of classes, for words of their own and shared; above, so many times the root of the number of different words.
OWN, SHARED = 96, 32
OWN_ROOTS, SHARED_ROOTS = 2.0, 0.25
CLASSES = OWN + SHARED
#: Most words whose counts are sent to all tasks, 16 bytes each, the most frequent ones; the counts of all others are joined.
KNOWN = 1 << 18
#: Counts up to here are told apart one by one when the most frequent words are sought, larger ones by 64 steps an octave.
FINE = 4096
#: The last row of a position table.
EDGE = -1
SIDES = (-2, -1, 1, 2)
HIDDEN = 16
BATCH, CHUNK = 1024, 8192
#: Words of a group of documents, at least; a network of many weights gets larger groups, so that weights stay few against words.
GROUP_WORDS, WORDS_A_WEIGHT = 2_000_000, 8
#: Networks that the driver averages; more of them are averaged on the executors before.
AVERAGED = 8
#: Rows handed to Python at a time: bounds a task's memory.
ROWS = 1000

CODED = "row long, doc_id long, grp long, ord long, n long, base double, classes binary, rest array<long>"
WEIGHTS = "grp long, n long, weights binary"


def count(docs: DataFrame) -> DataFrame:
    """(hash, n): how often each lower-cased word stands in all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch_words(batch.column(0), NOT_SPACE, most=1 << 22):
                some, n = np.unique(w.hashes(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n)], names=["hash", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(counted, "hash long, n long")
    return materialise(rows.groupBy("hash").agg(F.sum("n").alias("n")), "words")


@dataclass
class Vocabulary:
    """hashes, counts: the most frequent words, by hash. ids: their classes. own: how many words are classes of their own; these come
    first. total: logarithm of each shared class's weight, the counts of its words and one more for each, and one for words that the
    corpus never had. prior: logarithm of each class's share of the corpus. size: words of the corpus. table: the counts of all words."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    own: int
    total: np.ndarray
    prior: np.ndarray
    size: int
    table: DataFrame | None = None

    def sent(self) -> Vocabulary:
        return Vocabulary(self.hashes, self.counts, self.ids, self.own, self.total, self.prior, self.size)

    @property
    def kind(self) -> type:
        """What holds the number of a class."""
        return np.uint16 if self.prior.size < 1 << 16 else np.uint32

    def code(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, logarithm of the share within it, whether the count has still to be joined) of each word. A share that lacks its
        count is that of a word the corpus never had."""
        some, which = np.unique(hashes, return_inverse=True)
        cls = self.own + shared_class(some, self.total.size)
        share = -self.total[cls - self.own]
        known = np.zeros(some.size, bool)
        if self.hashes.size:
            at = np.minimum(np.searchsorted(self.hashes, some), self.hashes.size - 1)
            known = self.hashes[at] == some
            cls = np.where(known, self.ids[at], cls)
            share = np.where(known, np.where(cls < self.own, 0.0, share + np.log(self.counts[at] + 1.0)), share)
        return cls[which], share[which], ~known[which]


def shared_class(hashes: np.ndarray, shared: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shared)).astype(np.int64)


def vocabulary(table: DataFrame) -> Vocabulary:
    """The classes of a corpus, given its counts. The driver sees at most KNOWN words and one row for each shared class."""
    n = F.col("n")
    step = F.when(n <= FINE, n).otherwise(FINE + F.floor(64 * F.log2(n / FINE))).cast("long")
    found = sorted(((r[0], r[1]) for r in table.groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True)
    kinds, least, many = sum(c for _, c in found), None, 0
    for s, c in found:
        if many + c > KNOWN:
            break
        least, many = s, many + c
    top = table.where(step >= least if least is not None else F.lit(False)).toArrow()
    hashes, counts = top["hash"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.float64)
    order = np.lexsort((hashes, -counts))
    own = min(order.size, max(OWN, int(OWN_ROOTS * math.sqrt(kinds))))
    shared = max(SHARED, int(SHARED_ROOTS * math.sqrt(kinds)))
    ids = own + shared_class(hashes, shared)
    ids[order[:own]] = np.arange(own)
    sums = np.concatenate([counts[order[:own]], np.zeros(shared)])
    weight = np.ones(shared)
    slot = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(shared))
    for s, total, words in table.groupBy(slot.alias("slot")).agg(F.sum("n"), F.count("*")).collect():
        sums[own + s] += total
        weight[s] += total + words
    at = shared_class(hashes[order[:own]], shared)
    np.subtract.at(sums, own + at, counts[order[:own]])
    np.subtract.at(weight, at, counts[order[:own]] + 1)
    size = int(sums.sum())
    sums[own:] += 1.0
    sort = np.argsort(hashes)
    return Vocabulary(hashes[sort], counts[sort], ids[sort], own, np.log(weight), np.log(sums / sums.sum()), size, table)


@dataclass
class Network:
    """A class is place c % n of group c // n, n being the places of a group."""

    tables: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    @staticmethod
    def shapes(n: int) -> list[tuple[int, ...]]:
        places = math.isqrt(n - 1) + 1
        groups = -(-n // places)
        return [(len(SIDES), n + 1, HIDDEN), (HIDDEN, groups), (groups,), (groups, HIDDEN, places), (groups, places)]

    @classmethod
    def start(cls, prior: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        tables, out, bias, inner, inner_bias = cls.shapes(prior.size)
        full = np.full(inner_bias, -1e9)  # places without a class stay impossible
        full.reshape(-1)[: prior.size] = prior
        most = full.max(axis=1, keepdims=True)
        group = most[:, 0] + np.log(np.exp(full - most).sum(axis=1))
        parts = (rng.normal(0, 0.3, tables), rng.normal(0, 0.2, out), group, rng.normal(0, 0.2, inner), np.maximum(full - group[:, None], -1e9))
        return cls(*(x.astype(np.float32) for x in parts))

    @classmethod
    def unpack(cls, flat: np.ndarray, n: int) -> Network:
        parts, at = [], 0
        for shape in cls.shapes(n):
            size = math.prod(shape)
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return cls(*parts)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.tables, self.out, self.bias, self.inner, self.inner_bias

    def pack(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.parts()])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.tables[j][around[:, j]] for j in range(len(SIDES))))

    def runs(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(group, place, runs of equal groups) of targets in the order of their groups."""
        group, place = np.divmod(target, self.inner_bias.shape[1])
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), target.size]
        return group, place, [(int(group[a]), a, b) for a, b in zip(edges, edges[1:]) if b > a]

    def within(self, h: np.ndarray, group: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """What the places of each target's group have before the softmax."""
        y = np.empty((len(h), self.inner_bias.shape[1]), np.float32)
        for k, a, b in runs:
            np.matmul(h[a:b], self.inner[k], out=y[a:b])
        y += self.inner_bias[group]
        return y

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target class between its neighbours."""
        out = np.empty(target.size)
        for lo in range(0, target.size, CHUNK):
            order = lo + np.argsort(target[lo : lo + CHUNK])
            h = self.hidden(around[order])
            group, place, runs = self.runs(target[order])
            z = h @ self.out + self.bias
            z -= z.max(axis=1, keepdims=True)
            logs = (z[np.arange(len(z)), group] - np.log(np.exp(z).sum(axis=1))).astype(np.float64)
            y = self.within(h, group, runs)
            y -= y.max(axis=1, keepdims=True)
            out[order] = logs + y[np.arange(len(y)), place] - np.log(np.exp(y).sum(axis=1))
        return out

    def descend(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        order = np.argsort(target)
        around = around[order]
        group, place, runs = self.runs(target[order])
        h = self.hidden(around)
        rate = np.float32(rate)

        def slope(z: np.ndarray, own: np.ndarray) -> np.ndarray:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(own.size), own] -= 1
            z /= target.size
            return z

        z = slope(h @ self.out + self.bias, group)
        back = z @ self.out.T
        self.out -= rate * (h.T @ z)
        self.bias -= rate * z.sum(axis=0)
        y = slope(self.within(h, group, runs), place)
        for k, a, b in runs:
            back[a:b] += y[a:b] @ self.inner[k].T
            self.inner[k] -= rate * (h[a:b].T @ y[a:b])
        if runs:
            self.inner_bias[[k for k, _, _ in runs]] -= rate * np.add.reduceat(y, [a for _, a, _ in runs], axis=0)
        back *= 1 - h * h
        for j in range(len(SIDES)):
            order = np.argsort(around[:, j])
            rows = around[order, j]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            self.tables[j][rows[first]] -= rate * np.add.reduceat(back[order], first, axis=0)


def contexts(classes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The classes of every word's neighbours; beyond its text's edge a word's neighbour is EDGE."""
    around = np.full((classes.size, len(SIDES)), EDGE, np.int64)
    for j, side in enumerate(SIDES):
        a, b = (slice(-side, None), slice(None, side)) if side < 0 else (slice(None, -side), slice(side, None))
        if classes.size > abs(side):
            around[a, j] = np.where(row[a] == row[b], classes[b], EDGE)
    return around


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """The documents as classes, written to the shared folder: a row for each, with its group, its place in it, the number of its words,
    the logarithms that known counts give, its classes, and the hashes of the words whose counts have to be joined."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words.sent())
    groups = group_count(words)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context, row = shared.value, TaskContext.get(), 0
        part = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for w in batch_words(batch.column(1), NOT_SPACE):
                n = np.diff(w.first)
                hashes = w.hashes()
                cls, share, rest = words.code(hashes)
                base = np.bincount(np.repeat(np.arange(n.size), n), share, n.size).astype(np.float64)
                cls = cls.astype(words.kind)
                packed = pa.array([cls[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])], pa.binary())
                left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)])[w.first], pa.int32()), pa.array(hashes[rest].view(np.int64)))
                order = batch.column(2).to_numpy(zero_copy_only=False)[w.lo : w.hi]
                numbers = part + row + np.arange(n.size)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0)[w.lo : w.hi], pa.array(order % groups), pa.array(order), pa.array(n.astype(np.int64)), pa.array(base), packed, left], names=["row", "doc_id", "grp", "ord", "n", "base", "classes", "rest"])
                row += n.size

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("ord", F.xxhash64("doc_id", "text"))
    path = new_path(spark, "classes")
    with batch_rows(spark, ROWS):
        rows.mapInArrow(coded, CODED).write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(CODED).parquet(path)


def group_count(words: Vocabulary) -> int:
    """Groups of documents, as the corpus has them whatever its partitions."""
    weights = sum(math.prod(s) for s in Network.shapes(words.prior.size))
    return max(1, -(-words.size // max(GROUP_WORDS, WORDS_A_WEIGHT * weights)))


def _flat(packed: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(classes, row) of the words of some documents."""
    n = np.array([len(p) for p in packed], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(packed), kind).astype(np.int64), np.repeat(np.arange(n.size), n)


class Descent:
    """Trains a network on one group of documents, which come in their order."""

    def __init__(self, begin: Network, kind: type, rate: float):
        self.net, self.kind, self.rate = Network(*(x.copy() for x in begin.parts())), kind, rate
        self.seen, self.held = 0, (np.zeros((0, len(SIDES)), np.int64), np.zeros(0, np.int64))

    def add(self, packed: list[bytes], end: bool = False) -> None:
        classes, row = _flat(packed, self.kind)
        around, own = np.concatenate([self.held[0], contexts(classes, row)]), np.concatenate([self.held[1], classes])
        stop = own.size if end else own.size - own.size % BATCH
        for lo in range(0, stop, BATCH):
            self.net.descend(around[lo : lo + BATCH], own[lo : lo + BATCH], self.rate / (1 + self.seen / 200_000))
            self.seen += min(BATCH, stop - lo)
        self.held = (around[stop:], own[stop:])


def train(coded: DataFrame, words: Vocabulary, rate: float = 1.0) -> Network:
    """Average of the networks of all groups, with every word of their documents as target once."""
    spark = coded.sparkSession
    begin = Network.start(words.prior)
    shared = spark.sparkContext.broadcast((begin, words.kind))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, descent = None, None

        def out() -> pa.RecordBatch:
            descent.add([], end=True)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([descent.seen], pa.int64()), pa.array([descent.net.pack().tobytes()], pa.binary())], names=["grp", "n", "weights"])

        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), groups.size]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if groups[lo] != at:
                    if descent:
                        yield out()
                    at, descent = int(groups[lo]), Descent(*shared.value, rate)
                for k in range(lo, hi, 64):
                    descent.add(batch.column(2)[k : min(k + 64, hi)].to_pylist())
        if descent:
            yield out()

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for g, n, weights in zip(*(c.to_pylist() for c in batch.columns)):
                held = totals.setdefault(g, [0, 0.0])
                held[0] += n
                held[1] = held[1] + n * np.frombuffer(weights, np.float32).astype(np.float64)
        for g, (n, total) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["grp", "n", "weights"])

    n = group_count(words)
    # A group is a partition of its own: hashing the few groups would put several of them into one task and none into another.
    rows = coded.where("n > 0").select("grp", "ord", "classes").repartitionById(n, F.col("grp").cast("int")).sortWithinPartitions("grp", "ord")
    with batch_rows(spark, ROWS):
        parts = materialise(rows.mapInArrow(local, WEIGHTS), "weights")
    with batch_rows(spark, 4):
        while n > AVERAGED:
            n = max(AVERAGED, n // 32)
            dealt = parts.select(F.pmod("grp", F.lit(n)).alias("grp"), "n", "weights").repartition(n, "grp").sortWithinPartitions("grp", "n", F.xxhash64("weights"))
            parts = materialise(dealt.mapInArrow(averaged, WEIGHTS), "weights")
    got = sorted((r[0], r[1], bytes(r[2])) for r in parts.collect())  # at most AVERAGED rows
    if not got:
        return begin
    total = sum(r[1] for r in got)
    return Network.unpack(sum(r[1] / total * np.frombuffer(r[2], np.float32).astype(np.float64) for r in got), words.prior.size)


def score_coded(coded: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """The scores of documents that are written as classes."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((net, words.kind))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, kind = shared.value
        for batch in batches:
            logs = batch.column(3).to_numpy(zero_copy_only=False).copy()
            for lo in range(0, batch.num_rows, 64):
                packed = batch.column(4)[lo : lo + 64].to_pylist()
                classes, row = _flat(packed, kind)
                logs[lo : lo + len(packed)] += np.bincount(row, net.log_probability(contexts(classes, row), classes), len(packed))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logs)], names=["row", "doc_id", "n_words", "logs"])

    few = coded.select("row", "doc_id", F.col("n").alias("n_words"), "base", "classes").mapInArrow(scored, "row long, doc_id long, n_words long, logs double")
    # Only words that are rare in the corpus are joined: no key is hot.
    rare = coded.select("row", F.explode("rest").alias("hash")).join(words.table, "hash").groupBy("row").agg(F.sum(F.log(F.col("n") + 1.0)).alias("more"))
    some = F.col("n_words") > 0
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    mean = F.when(some, logs / F.col("n_words"))
    return few.join(rare, "row", "left").select(
        "doc_id", "n_words", logs.alias("log_likelihood"), mean.alias("mean_log_probability"), F.exp(F.least(-mean, F.lit(700.0))).alias("pseudo_perplexity")
    )


def learn(docs: DataFrame) -> tuple[Vocabulary, Network]:
    """Classes and network of a corpus."""
    words = vocabulary(count(docs))
    return words, train(encode(docs, words), words)


def score(docs: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_words, log_likelihood (natural logarithms, summed), its mean over words, and the pseudo-perplexity.

    Null and empty texts have no words, likelihood 0 and null means. Words that the corpus never had are scored like others of
    their class with a count of 0. Equal texts get equal scores up to rounding, repeated rows stay repeated and count in training,
    an empty table gives no row. Only doc_id and text are read. Texts are read whole. Scores are the same for any partitioning.
    """
    return score_coded(encode(docs, words), words, net)


def score_corpus(docs: DataFrame) -> DataFrame:
    """`score` of the documents under a model learned from themselves; they are written as classes once."""
    words = vocabulary(count(docs))
    coded = encode(docs, words)
    return score_coded(coded, words, train(coded, words))
