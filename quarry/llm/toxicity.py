"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a lexicon, the nearness of its words to second-person pronouns, and the rates of capitals,
punctuation and obfuscated words. The lexicon (words and word beginnings) is induced from the labelled rows; for the fit it is
induced on one half of them and measured on the other, so that the trees see it as new texts will show it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import is_held_out, labelled_sample
from quarry.llm.words import byte_class, hash_spans, mix, text_slices, words_of

#: Most labelled rows that a fit reads: the documented bound of the fit.
SAMPLE = 8_000
THRESHOLD = 0.5
#: Words within this distance of a second-person pronoun count as addressed.
NEAR = 5
STEM = 5
#: Second-person pronouns of the corpus languages (fixed values).
PRONOUNS = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros"
#: What stands for a letter in a disguised word (fixed values).
DISGUISE = b"@$!013457*"

_WORD = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d.,;:?\"()[]{}<>/\\|")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(97, 123), *range(128, 256)]] = True
_IS_DISGUISE = np.zeros(256, bool)
_IS_DISGUISE[list(DISGUISE)] = True
_UNDISGUISE = _LOWER.copy()
for _from, _to in zip(b"@$!013457", b"asioieast"):
    _UNDISGUISE[_from] = _to


def hash_words(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    return hash_spans(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


class Terms:
    """A sorted set of 64-bit hashes with a weight each; lookups are cheap for the many words that are not in it."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.size, np.float32)
        if self.keys.size:
            at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, hashes[at]), self.keys.size - 1)
            hit = self.keys[place] == hashes[at]
            out[at[hit]] = self.weights[place[hit]]
        return out


_PRONOUN = Terms(hash_words(PRONOUNS.split()), np.ones(len(PRONOUNS.split()), np.float32))


@dataclass
class Cut:
    """The words of some texts: their hashes, those of their beginnings, and what the rates are counted from."""

    offsets: np.ndarray
    first: np.ndarray
    words: np.ndarray
    stems: np.ndarray
    clear: np.ndarray
    disguised: np.ndarray
    rates: np.ndarray


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(values.size + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def cut(data: np.ndarray, offsets: np.ndarray) -> Cut:
    low = _LOWER[data]
    w = words_of(0, offsets.size - 1, low, offsets, _WORD)
    starts, ends = w.starts, w.ends
    # Punctuation behind a word is not part of it: a word ends with its last letter or digit, if it has one.
    hard = _IS_LETTER[low] | ((low - np.uint8(48)) < 10)
    last = np.maximum.accumulate(np.where(hard, np.arange(low.size), -1)) if low.size else np.zeros(0, np.int64)
    ends = np.maximum(last[ends - 1], starts) + 1
    words = hash_spans(low, starts, ends)
    stems = np.where(ends - starts > STEM, hash_spans(low, starts, np.minimum(ends, starts + STEM)), np.uint64(0))
    letters = np.zeros(data.size + 1, np.int64)
    np.cumsum(_IS_LETTER[low], out=letters[1:])
    odd = np.zeros(data.size + 1, np.int64)
    np.cumsum(_IS_DISGUISE[low], out=odd[1:])
    n_odd = odd[ends] - odd[starts]
    disguised = (n_odd > 0) & (letters[ends] - letters[starts] >= 2)
    clear = words
    if disguised.any():
        clear = words.copy()
        clear[disguised] = hash_spans(_UNDISGUISE[low], starts[disguised], ends[disguised])
    size = np.maximum(np.diff(offsets), 1)
    capital = (data - np.uint8(65)) < 26
    # Bytes at the word starts, an upper-case letter apart: shouting is a capital inside a word.
    shout = capital.copy()
    shout[w.starts] = False
    exclaim = (data == 33) | (data == 63)
    punct = ((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127))
    digit = (data - np.uint8(48)) < 10
    rates = np.stack([_sums(x, offsets) / size for x in (capital, shout, exclaim, punct, digit)], axis=1)
    return Cut(offsets, w.first, words, stems, clear, disguised, rates)


@dataclass
class Lexicon:
    words: Terms
    stems: Terms

    def features(self, c: Cut) -> np.ndarray:
        weight = np.maximum(self.words.weigh(c.clear), 0)
        hit = weight > 0
        stem = np.where(c.stems != 0, self.stems.weigh(c.stems), 0)
        any_hit = hit | (stem > 0)
        n = np.diff(c.first)
        some = np.maximum(n, 1)
        pronoun = _PRONOUN.weigh(c.words) > 0
        total = np.zeros(pronoun.size + 1, np.int64)
        np.cumsum(pronoun, out=total[1:])
        at = np.flatnonzero(any_hit)
        text = np.searchsorted(c.first, at, side="right") - 1
        near = total[np.minimum(at + NEAR + 1, c.first[text + 1])] - total[np.maximum(at - NEAR, c.first[text])]
        n_near = np.bincount(text, weights=near > 0, minlength=n.size)
        top = np.zeros(n.size)
        np.maximum.at(top, text, np.maximum(weight, stem)[at])
        hits, stems = _sums(hit, c.first), _sums(stem > 0, c.first)
        sum_words, sum_stems = _sums(weight, c.first), _sums(stem, c.first)
        odd = _sums(c.disguised, c.first)
        return np.column_stack([
            hits, hits / some, stems, stems / some, sum_words, sum_words / some, sum_stems, sum_stems / some, top,
            n_near, n_near / some, _sums(pronoun, c.first) / some, odd, odd / some,
            _sums(c.disguised & any_hit, c.first), np.log1p(n), c.rates,
        ]).astype(np.float32)


#: Where the ranges of hashes begin in which terms are counted.
_RANGES = np.arange(16, dtype=np.uint64) << np.uint64(60)


def induce(cuts: list[Cut], y: np.ndarray) -> Lexicon:
    """Words and beginnings that stand in at least three toxic texts and are at least e**2 times likelier there."""

    def terms(pick: str, least: float) -> Terms:
        found: list[np.ndarray] = [np.unique(getattr(c, pick)) for c in cuts]
        if not found or not y.any():
            return Terms(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        # The terms are counted in ranges of their hashes, one after another: a part of all at a time bounds the driver's memory.
        edges = np.array([[*np.searchsorted(f, _RANGES), f.size] for f in found])
        counts = []
        for lo, hi in zip(edges.T[:-1], edges.T[1:]):
            keys, which = np.unique(np.concatenate([f[a:b] for f, a, b in zip(found, lo, hi)]), return_inverse=True)
            label = np.repeat(y, hi - lo)
            toxic = np.bincount(which, weights=label, minlength=keys.size)
            counts.append((keys, toxic, np.bincount(which, minlength=keys.size) - toxic))
        keys, toxic, other = (np.concatenate(x) for x in zip(*counts))
        n1, n0 = y.sum(), max(1, (1 - y).sum())
        odds = np.log((toxic + 0.1) / (n1 + 0.2)) - np.log((other + 0.5) / (n0 + 1.0))
        good = (toxic >= 3) & (odds >= least) & (keys != 0)
        # Of a term as rare as this, so many toxic texts by chance would be a rare case.
        good &= toxic * np.log(n1 / (n1 + n0)) + (toxic + other) * np.log(2) * (other > 0) < -6.5
        best = np.flatnonzero(good)
        best = best[np.argsort(-odds[best] * np.log1p(toxic[best]), kind="stable")]
        return Terms(keys[best], odds[best].astype(np.float32))

    return Lexicon(terms("clear", 2.0), terms("stems", 2.5))


@dataclass
class Trees:
    """Boosted regression trees of fixed depth over binned features, kept as flat arrays."""

    base: float = 0.0
    depth: int = 3
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3, ridge: float = 1.0) -> Trees:
    """Logistic gradient boosting with histogram splits."""
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    trees = Trees(float(np.log(prior / (1 - prior))), depth)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    width = max(e.size for e in edges) + 1
    score, n_inner = np.full(len(y), trees.base), 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low, n_nodes = 2**level - 1, 2**level
            best, gain = np.zeros((n_nodes, 2), np.int64), np.full(n_nodes, 1e-6)
            for k in range(x.shape[1]):
                at = (node - low) * width + bins[:, k]
                gs = np.bincount(at, g, n_nodes * width).reshape(n_nodes, width).cumsum(axis=1)
                hs = np.bincount(at, h, n_nodes * width).reshape(n_nodes, width).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                won = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                won[(hs < 1e-3) | (ha - hs < 1e-3)] = 0
                top = won.argmax(axis=1)
                better = won[np.arange(n_nodes), top] > gain
                gain[better] = won[np.arange(n_nodes), top][better]
                best[better] = np.stack([np.full(n_nodes, k), top], axis=1)[better]
            for j in range(n_nodes):
                k, b = best[j]
                if gain[j] > 1e-6 and b < edges[k].size:
                    feature[low + j], limit[low + j] = k, edges[k][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - n_inner
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        values = -rate * gs / (hs + ridge)
        score = score + values[leaf]
        trees.features.append(feature)
        trees.limits.append(limit)
        trees.leaves.append(values)
    return trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, values) of a rising curve through the pooled means."""
    order = np.argsort(score, kind="stable")
    mean, weight, at = [], [], []
    for s, v in zip(score[order], y[order]):
        mean.append(float(v))
        weight.append(1.0)
        at.append([float(s), float(s)])
        while len(mean) > 1 and mean[-2] >= mean[-1]:
            w = weight[-2] + weight[-1]
            mean[-2:] = [(mean[-2] * weight[-2] + mean[-1] * weight[-1]) / w]
            weight[-2:] = [w]
            at[-2:] = [[at[-2][0], at[-1][1]]]
    xs = np.array(at).reshape(-1)
    return xs, np.repeat(mean, 2)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    curve: tuple[np.ndarray, np.ndarray]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(self.lexicon.features(cut(data, offsets)))
        return np.clip(np.interp(raw, *self.curve), 0.0, 1.0)


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """Train on (id, text, label) rows. Without both labels every text gets the share of label 1 (0 without rows)."""
    y = np.array([float(r[2]) for r in rows])
    cuts = []
    for _, text, _ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        cuts.append(cut(data, np.array([0, data.size])))
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.0
        return Model(induce([], np.zeros(0)), Trees(), (np.array([0.0]), np.array([mean])))
    half = (mix(np.array([r[0] & (2**63 - 1) for r in rows], np.uint64)) & np.uint64(1)).astype(bool)
    x = np.zeros((len(rows), 0), np.float32)
    parts = {}
    for side in (False, True):
        other = np.flatnonzero(half != side)
        lexicon = induce([cuts[k] for k in other], y[other])
        for k in np.flatnonzero(half == side):
            parts[k] = lexicon.features(cuts[k])[0]
    x = np.stack([parts[k] for k in range(len(rows))])
    raw = np.zeros(len(rows))
    for side in (False, True):
        learn, check = half != side, half == side
        raw[check] = boost(x[learn], y[learn]).raw(x[check]) if learn.any() and check.any() else 0.0
    return Model(induce(cuts, y), boost(x, y), isotonic(raw, y))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for lo, hi, data, offsets in text_slices(batch.column(2)):
            score[lo:hi] = model.score(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows that are not held out."""
    return fit(labelled_sample(docs, labels, "toxic", sample))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5 on).

    Null and empty texts are scored as texts without words. Equal texts get equal scores, repeated rows stay repeated, an empty
    table gives no row. Only doc_id and text are read, whatever other columns are called. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scored(batches, shared.value), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with their own columns, that the model does not reject. Rows without text stay.

    Python sees the texts alone; the verdict is a column beside the row, and the JVM filters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        good = np.ones(len(texts), bool)
        for lo, hi, data, offsets in text_slices(texts):
            good[lo:hi] = shared.value.score(data, offsets) < THRESHOLD
        return pa.array(good)

    return docs.where(clean(F.col("text").cast("string")))
