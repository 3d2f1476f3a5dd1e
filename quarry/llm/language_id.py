"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its subwords (byte 2-, 3- and 4-grams of lower-cased words, with word borders, hashed into
buckets); a linear softmax reads the language off that mean. Embeddings and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows. A temperature and a rejection threshold are then fitted on rows that the
descent did not see. As the model is linear in the mean, scoring adds up one small row of class scores for each subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import is_held_out, labelled_sample
from quarry.llm.words import mix, text_slices

BUCKETS = 1 << 15
#: Most labelled rows that a fit reads: the documented bound of the fit.
SAMPLE = 3_000
UNDETERMINED = "und"

#: Lower-case bytes; everything in ASCII that is no letter is a border.
_BORDER = 32
_FOLD = np.full(256, _BORDER, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each subword length (buckets, borders): the hashed subwords of all texts in turn, and where those of each text start."""
    n_texts = offsets.size - 1
    # One border byte before each text and one behind the last keep subwords inside their text.
    begins = offsets + np.arange(n_texts + 1)
    folded = np.full(data.size + n_texts + 1, _BORDER, dtype=np.uint8)
    inside = np.ones(folded.size, dtype=bool)
    inside[begins] = False
    folded[inside] = _FOLD[data]
    letter = folded != _BORDER
    code = folded.astype(np.uint32)
    keep = letter
    for n in (2, 3, 4):
        if folded.size < n:
            return
        code = (code[:-1] << 8) | folded[n - 1 :]
        keep = keep[:-1] & letter[n - 2 : -1] if n > 2 else letter[:-1] | letter[1:]
        if n == 3:  # the first two bytes may hold a border only in front
            keep = (letter[:-2] | letter[1:-1]) & letter[1:-1]
        where = np.flatnonzero(keep)
        buckets = ((code[where] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
        yield buckets, np.searchsorted(where, begins)


@dataclass
class Model:
    """scores: buckets x languages, embedding times softmax weights. temperature and threshold are calibrated."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, calibrated probability) of each text."""
        total, n = np.zeros((offsets.size - 1, self.scores.shape[1])), np.zeros(offsets.size - 1)
        for buckets, borders in subwords(data, offsets):
            count = np.diff(borders)
            full = np.flatnonzero(count)
            if full.size:
                total[full] += np.add.reduceat(self.scores[buckets], borders[full], axis=0)
                n += count
        logits = total / np.maximum(n, 1)[:, None] + self.bias
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(best.size), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _cuts(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """The text and two short stretches of it, so that short texts are learned as well as long ones."""
    out = [text]
    for _ in range(2):
        n = int(rng.integers(12, 90))
        a = int(rng.integers(0, max(1, len(text) - n)))
        out.append(text[a : a + n])
    return out


def fit(rows: list[tuple[int, str, str]], dim: int = 16, epochs: int = 3, rate: float = 2.0, seed: int = 3) -> Model:
    """Train on (id, text, language) rows; without rows, a model of no language."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    held = np.array([int(mix(np.array([r[0] & (2**63 - 1)], np.uint64))[0] % np.uint64(5)) == 0 for r in rows])
    examples = []
    for (_, text, language), out in zip(rows, held):
        for cut in _cuts(text.encode(), rng):
            data = np.frombuffer(cut, np.uint8)
            parts = [b for b, _ in subwords(data, np.array([0, data.size]))]
            buckets, counts = np.unique(np.concatenate(parts), return_counts=True)
            if buckets.size:
                examples.append((buckets, (counts / counts.sum()).astype(np.float32), languages.index(language), bool(out)))
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weight = rng.normal(0, 0.3, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    train = [e for e in examples if not e[3]] or examples
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            buckets, share, language, _ = train[k]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ embed[buckets]
            logits = hidden @ weight + bias
            g = np.exp(logits - logits.max())
            g /= g.sum()
            g[language] -= 1
            back = weight @ g
            weight -= (0.1 * lr) * np.outer(hidden, g)
            bias -= (0.01 * lr) * g
            embed[buckets] -= (lr * 5) * share[:, None] * back[None, :]
    scores = (embed @ weight).astype(np.float32)
    check = [e for e in examples if e[3]] or examples
    logits = np.array([e[1] @ scores[e[0]] + bias for e in check])
    truth = np.array([e[2] for e in check])
    best = min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(_softmax(logits / t)[np.arange(truth.size), truth] + 1e-12).mean())
    p = _softmax(logits / best)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    # The lowest threshold above which all but one answer in a hundred are right.
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) >= 0.99 * np.arange(1, top.size + 1))
    threshold = float(top[order[good[-1]]]) if good.size else 1.0
    return Model(languages, scores, bias.astype(np.float64), best, threshold)


def _has_letter(lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = (data | 32) - np.uint8(97) < 26
    high = data >= 128
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = total[offsets[1:]] > total[offsets[:-1]]
    above = np.concatenate([[0], np.cumsum(high)])
    for k in np.flatnonzero(~found & (above[offsets[1:]] > above[offsets[:-1]])):
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = [*model.languages, UNDETERMINED]
    for batch in batches:
        n = batch.num_rows
        best, p = np.full(n, len(model.languages)), np.zeros(n)
        for lo, hi, data, offsets in text_slices(batch.column(2)):
            letter = _has_letter(lo, hi, data, offsets)
            if model.languages:
                got, sure = model.predict(data, offsets)
                best[lo:hi] = np.where(letter, got, len(model.languages))
                p[lo:hi] = np.where(letter, sure, 0.0)
        said = pa.DictionaryArray.from_arrays(pa.array(best, pa.int32()), pa.array(names)).cast(pa.string())
        rejected = (best == len(model.languages)) | (p < model.threshold)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), said, pa.array(p, pa.float64()), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of docs that are not held out and have a language."""
    return fit(labelled_sample(docs, None, "lang", sample))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (calibrated probability), rejected (score below the calibrated threshold).

    A null text and one without a letter are `und` with score 0 and rejected; so is every text when no row was labelled. Equal
    texts get equal rows, repeated rows stay repeated, an empty table gives no row; columns besides doc_id and text (and lang in
    training) are not read. Texts are scored whole; ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scored(batches, shared.value), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")
