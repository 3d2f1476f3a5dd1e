"""Quality: nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of weighted term counts. The terms are hashed words, hashed runs of three character shapes (letter, capital,
digit, space, each punctuation mark) and a few binned ratios such as the share of different words. A truncated singular value
decomposition of the labelled rows' vectors gives the latent space. The labelled vectors, whose number is bounded, are broadcast;
every document's cosine with all of them is computed exactly, block by block, and its nearest neighbours vote with their labels,
weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import is_held_out, labelled_sample
from quarry.llm.words import NOT_SPACE, text_slices, words_of

#: Most labelled rows that a fit reads and broadcasts: the documented bound.
SAMPLE = 2_500
DIMENSIONS = 48
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Documents whose terms and products with all labelled vectors are held at a time: bounds a task's memory, however short the texts.
BLOCK = 256
#: Decimals to which similarities are compared: equal texts tie, whatever block they stand in.
TIES = 5

WORD_TERMS, SHAPE_TERMS, BINS = 2048, 2048, 8
RATIOS = 7
TERMS = WORD_TERMS + SHAPE_TERMS + RATIOS * BINS

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.zeros(256, np.uint32)
_SHAPE[[b for b in range(33, 127) if not chr(b).isalnum()]] = np.arange(32) + 8
_SHAPE[97:123], _SHAPE[128:], _SHAPE[65:91], _SHAPE[48:58] = 1, 1, 2, 3
_SHAPE[[32, 9]], _SHAPE[[10, 13]] = 4, 5


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(values.size + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word term counts, shape term counts, ratios) of each text."""
    n = offsets.size - 1
    w = words_of(0, n, _LOWER[data], offsets, NOT_SPACE)
    hashes = w.hashes()
    text = np.repeat(np.arange(n), np.diff(w.first))
    words = np.bincount(text * WORD_TERMS + (hashes % np.uint64(WORD_TERMS)).astype(np.int64), minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
    shapes = np.zeros((n, SHAPE_TERMS))
    if data.size > 2:
        s = _SHAPE[data]
        code = ((((s[:-2] * 41 + s[1:-1]) * 41 + s[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(offsets))
        inside = row[2:] == row[:-2]
        shapes = np.bincount((row[:-2] * SHAPE_TERMS + code)[inside], minlength=n * SHAPE_TERMS).reshape(n, SHAPE_TERMS)
    many = np.maximum(np.diff(w.first), 1)
    size = np.maximum(np.diff(offsets), 1)
    again = np.zeros(hashes.size, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((hashes, text))
    same = np.zeros(hashes.size, bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    letter = (data | 32) - np.uint8(97) < 26
    capital = (data - np.uint8(65)) < 26
    mark = _SHAPE[data] >= 8
    ratios = np.stack([
        _per_text(again, w.first) / many,
        _per_text(same, w.first) / many,
        np.minimum(1, _per_text((w.ends - w.starts).astype(float), w.first) / many / 20),
        np.minimum(1, np.log1p(np.diff(w.first)) / 9),
        _per_text(capital, offsets) / np.maximum(1, _per_text(letter, offsets)),
        np.minimum(1, 3 * _per_text(mark, offsets) / size),
        np.minimum(1, 10 * _per_text(data == 10, offsets) / size),
    ], axis=1)
    return words, shapes, ratios


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def raw_vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit blocks of word, shape and ratio terms side by side; a text without words is the zero vector."""
    words, shapes, ratios = term_counts(data, offsets)
    at = ratios * (BINS - 1)
    low = np.minimum(at.astype(int), BINS - 2)
    bins = np.zeros((len(ratios), RATIOS, BINS))
    rows, which = np.ogrid[: len(ratios), :RATIOS]
    bins[rows, which, low] = 1 - (at - low)
    bins[rows, which, low + 1] = at - low
    some = words.sum(axis=1, keepdims=True) > 0
    blocks = [0.35 * _unit(np.sqrt(words)), _unit(np.sqrt(shapes)), _unit(bins.reshape(len(ratios), -1))]
    return (np.concatenate(blocks, axis=1) * some).astype(np.float32)


@dataclass
class Model:
    """weight: inverse document frequency of each term. axes: terms x dimensions. vectors, labels: the labelled rows."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _unit((raw_vectors(data, offsets) * self.weight) @ self.axes)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        mine = self.project(data, offsets)
        out = np.full(len(mine), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for lo in range(0, len(mine), BLOCK):
            block = mine[lo : lo + BLOCK]
            cosine = np.round(block @ self.vectors.T, TIES)
            # All that are as near as the last neighbour vote, so that ties need no choice.
            least = np.partition(cosine, -k, axis=1)[:, -k]
            weight = np.where(cosine >= np.maximum(least, 0.0)[:, None], cosine, 0.0)
            weight *= weight
            weight *= weight
            weight *= weight
            total = weight.sum(axis=1, dtype=np.float64)
            some = total > 1e-9
            out[lo : lo + len(block)][some] = (weight @ self.labels)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def fit(rows: list[tuple[int, str, int]], dimensions: int = DIMENSIONS, seed: int = 5) -> Model:
    """Fit on (id, text, label) rows by a randomised decomposition; without rows every score is one half."""
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, (_, text, _) in enumerate(rows):
        data = np.frombuffer(text.encode(), np.uint8)
        x[k] = raw_vectors(data, np.array([0, data.size]))[0]
    weight = (1.0 + np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0)))).astype(np.float32)
    x *= weight
    rng = np.random.default_rng(seed)
    size = min(dimensions + 16, *x.shape)
    q = rng.normal(size=(x.shape[1], size)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T[:, : min(dimensions, size)]).astype(np.float32)
    labels = np.array([float(r[2]) for r in rows])
    return Model(weight, axes, _unit(x @ axes).astype(np.float32), labels, float(labels.mean()))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for lo, hi, data, offsets in text_slices(batch.column(2), rows=BLOCK):
            score[lo:hi] = model.score(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows that are not held out."""
    return fit(labelled_sample(docs, labels, "quality", sample))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3 on).

    Null and empty texts and texts without words get the share of label 1 among the labelled rows. Labelled rows as near as the last
    neighbour, to five decimals, all vote. Equal texts get equal scores up to rounding, repeated rows stay repeated, an empty table gives no row. Only doc_id and text are read, whatever other
    columns are called. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scored(batches, shared.value), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
