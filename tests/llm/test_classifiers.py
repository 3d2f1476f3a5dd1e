import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id, quality, toxicity
from quarry.llm.common import highest_rank, labelled_sample
from quarry.llm.words import hash_spans
from tests.llm.fixtures import AWKWARD, documents, empty

LANGUAGES = {"aa": ["ba", "ke", "ti", "mo", "lu"], "bb": ["sch", "ung", "ein", "ver", "heit"], "cc": ["ción", "ñas", "que", "los", "rra"]}


def language_text(rng, name, n):
    return " ".join("".join(rng.choices(LANGUAGES[name], k=rng.randint(1, 3))) for _ in range(n))


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_language_on_held_out_rows(spark):
    rng = random.Random(1)
    names = [rng.choice(list(LANGUAGES)) for _ in range(400)]
    docs = spark.createDataFrame([(k, language_text(rng, n, rng.choice([3, 20, 200])), n) for k, n in enumerate(names)], "doc_id long, text string, lang string")
    # Labels of held-out rows must not matter.
    spoiled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz").otherwise(F.col("lang")))
    model = language_id.learn(spoiled)
    assert model.languages == sorted(LANGUAGES)
    rows = language_id.identify(docs, model).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == names[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_language_of_awkward_texts(spark):
    model = language_id.fit([(k, language_text(random.Random(k), n, 30), n) for k, n in enumerate(list(LANGUAGES) * 20)])
    rows = {r.doc_id: r for r in language_id.identify(documents(spark, AWKWARD), model).collect()}
    for k, text in enumerate(AWKWARD):
        assert (rows[k].lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
    assert rows[8][2:] == rows[9][2:]
    assert language_id.identify(empty(spark), model).collect() == []
    none = language_id.identify(documents(spark, AWKWARD), language_id.learn(documents(spark, AWKWARD).withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_sample_is_bounded_and_skips_the_held_out_fold(spark):
    docs = documents(spark, [f"text {k}" for k in range(500)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    rows = labelled_sample(docs, labels, "toxic", 100)
    assert len(rows) == 100 and not any(held(r[0]) for r in rows)
    assert rows == labelled_sample(docs.repartition(7), labels.repartition(5), "toxic", 100)


def test_sample_settles_conflicts_alike(spark):
    docs = documents(spark, ["b", "c"]).unionByName(documents(spark, ["a", None]))
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, None)], "doc_id long, toxic int")
    expected = [r for r in [(0, "a", 0), (1, "c", 1)] if not held(r[0])]
    for n in (1, 7):
        assert labelled_sample(docs.repartition(n), labels.repartition(n), "toxic", 10) == expected


def test_sample_takes_as_many_jobs_for_any_partitioning(spark):
    docs = documents(spark, [f"text {k}" for k in range(500)])
    jobs = []
    for n in (2, 40):
        spark.sparkContext.setJobGroup(f"sample-{n}", "")
        labelled_sample(docs.repartition(n), None, "lang", 10)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sample-{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 2


def test_share_of_very_large_tables():
    for n in (10_000, 10**9, 3 * 10**9, 10**11, 10**14):
        share = (highest_rank(n, 3000) + (1 << 63)) / (1 << 64)
        assert abs(share * n - 6000) < 1


def labelled(spark, kind, n=600, seed=2):
    """kind 'toxic': insults mark label 1; 'quality': shouting and repetition mark label 0."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'a', 'en'])}" for _ in range(rng.choice([12, 60, 250]))]
        bad = rng.random() < 0.35
        if kind == "toxic":
            for _ in range(rng.randint(2, 4) if bad else 0):
                words.insert(rng.randrange(len(words)), rng.choice(["you", ""]) + " " + rng.choice(["snargle", "Frobnit", "quxling"]))
            labels.append(int(bad))
            texts.append(" ".join(words))
        else:
            style = rng.randrange(3)
            text = " ".join(words)
            texts.append(text if not bad else [text.upper().replace(" ", "!! "), " ".join(words[:2] * 40), " | ".join(words)][style])
            labels.append(int(not bad))
    docs = documents(spark, texts)
    return docs, spark.createDataFrame([(k, v, "clash") for k, v in enumerate(labels)], f"doc_id long, {kind} int, text string"), labels


@pytest.mark.parametrize(("module", "kind", "threshold"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_classifier_on_held_out_rows(spark, module, kind, threshold):
    docs, labels, truth = labelled(spark, kind)
    rows = module.score(docs, module.learn(docs, labels)).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == held(r.doc_id) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out]) > 0.95


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_on_awkward_input(spark, module, kind):
    docs, labels, _ = labelled(spark, kind, 60)
    model = module.learn(docs, labels)
    rows = {r.doc_id: r.score for r in module.score(documents(spark, AWKWARD), model).collect()}
    assert len(rows) == len(AWKWARD) and rows[0] == rows[1] and abs(rows[8] - rows[9]) < 1e-9
    assert module.score(empty(spark), model).collect() == []
    unlabelled = module.score(docs, module.learn(docs, labels.where("false"))).collect()
    assert len({r.score for r in unlabelled}) == 1


def test_toxicity_filter_keeps_columns_and_clean_rows(spark):
    docs, labels, truth = labelled(spark, "toxic")
    kept = toxicity.drop_toxic(docs, toxicity.learn(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {k for k, t in enumerate(truth) if not t}
    assert len(clean - ids) <= 2 and len(ids - clean) <= 0.1 * len(truth)


def test_isotonic_curve_rises():
    rng = np.random.default_rng(1)
    score = rng.normal(size=500)
    xs, ys = toxicity.isotonic(score, (score + rng.normal(size=500) > 0).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()


def test_neighbours_are_exact():
    docs, rng = [], random.Random(4)
    for k in range(120):
        docs.append((k, " ".join(rng.choices(["a", "bb", "ccc", "DD!", "ee|"], k=30)), k % 2))
    model = quality.fit(docs)
    data = np.frombuffer(docs[5][1].encode(), np.uint8)
    mine = model.project(data, np.array([0, data.size]))[0]
    cosine = model.vectors @ mine
    near = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
    weight = np.maximum(cosine[near], 0) ** 8
    expected = (weight * model.labels[near]).sum() / weight.sum()
    assert abs(model.score(data, np.array([0, data.size]))[0] - expected) < 1e-3


def test_neighbours_that_tie_all_vote():
    rows = [(k, f"words here {k % 3} and there" * 3, k // 3 % 2) for k in range(180)]
    one, two = quality.fit(rows), quality.fit(rows)
    order = np.random.default_rng(3).permutation(len(rows))
    two.vectors, two.labels = two.vectors[order], two.labels[order]
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    assert abs(one.score(data, np.array([0, data.size]))[0] - two.score(data, np.array([0, data.size]))[0]) < 1e-6


def test_many_short_texts_take_little_memory():
    import tracemalloc

    model = quality.fit([(k, f"some text {k}", k % 2) for k in range(60)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([False] * 10_000), pa.array(["word"] * 10_000)], names=["doc_id", "held_out", "text"])
    tracemalloc.start()
    out = list(quality._scored(iter([batch]), model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].num_rows == 10_000 and peak < 300e6


def test_trailing_marks_are_cut_in_one_pass():
    import time

    text = ("plain words " * 20_000 + "end" + "!" * 1_000_000).encode()
    data = np.frombuffer(text, np.uint8)
    began = time.perf_counter()
    c = toxicity.cut(data, np.array([0, data.size]))
    assert time.perf_counter() - began < 5 and c.words[-1] == toxicity.hash_words(["end"])[0]


def slow_words(text):
    """The words of a text as the toxicity features count them, one character after the other."""
    words, word = [], b""
    for b in text.lower().encode() + b" ":
        if b in b" \t\n\v\f\r.,;:?\"()[]{}<>/\\|":
            if word:
                while len(word) > 1 and not (97 <= word[-1] <= 122 or 48 <= word[-1] <= 57 or word[-1] >= 128):
                    word = word[:-1]
                words.append(word)
            word = b""
        else:
            word += bytes([b])
    return words


def test_toxicity_features_and_trees_against_loops():
    rng = random.Random(6)
    vocabulary = ["you", "Snargle!", "fr0bnit", "plain", "WORD", "it's", "a", "(quux)", "12", "***", "dich"]
    rows = [(k, " ".join(rng.choices(vocabulary if k % 3 == 0 else vocabulary[3:], k=rng.randint(1, 30))), int(k % 3 == 0)) for k in range(300)]
    model = toxicity.fit(rows)
    weight = dict(zip(model.lexicon.words.keys.tolist(), model.lexicon.words.weights.tolist()))
    stem_weight = dict(zip(model.lexicon.stems.keys.tolist(), model.lexicon.stems.weights.tolist()))
    plain = bytes.maketrans(b"@$!013457", b"asioieast")
    pronouns = {p.encode() for p in toxicity.PRONOUNS.split()}

    def key(word):
        return int(hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])

    for _, text, _ in rows[:60]:
        words = slow_words(text)
        odd = [any(b in b"@$!013457*" for b in w) and sum(97 <= b <= 122 or b > 127 for b in w) >= 2 for w in words]
        found = [max(weight.get(key(w.translate(plain) if o else w), 0), 0) for w, o in zip(words, odd)]
        stems = [stem_weight.get(key(w[:5]), 0) if len(w) > 5 else 0 for w in words]
        either = [f > 0 or s > 0 for f, s in zip(found, stems)]
        near = sum(e and any(w in pronouns for w in words[max(0, k - 5) : k + 6]) for k, e in enumerate(either))
        n = max(1, len(words))
        hits, beginnings = sum(f > 0 for f in found), sum(s > 0 for s in stems)
        expected = [hits, hits / n, beginnings, beginnings / n, sum(found), sum(found) / n, sum(stems), sum(stems) / n, max(found + stems, default=0), near, near / n, sum(w in pronouns for w in words) / n, sum(odd), sum(odd) / n, sum(o and e for o, e in zip(odd, either)), np.log1p(len(words))]
        data = np.frombuffer(text.encode(), np.uint8)
        got = model.lexicon.features(toxicity.cut(data, np.array([0, data.size])))[0]
        assert np.allclose(got[: len(expected)], expected, atol=1e-5), text
        raw = model.trees.base
        for feature, limit, leaf in zip(model.trees.features, model.trees.limits, model.trees.leaves):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if got[feature[node]] > limit[node] else 1)
            raw += leaf[node - len(feature)]
        assert abs(model.score(data, np.array([0, data.size]))[0] - np.clip(np.interp(raw, *model.curve), 0, 1)) < 1e-9


def test_language_scores_against_loops():
    rows = [(k, language_text(random.Random(k), n, 30), n) for k, n in enumerate(list(LANGUAGES) * 20)]
    model = language_id.fit(rows)

    def pieces(text):
        folded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        data = folded.encode()
        letter = [b != 32 for b in data]
        for n in (2, 3, 4):
            for k in range(len(data) - n + 1):
                inner = letter[k + 1 : k + n - 1]
                if all(inner) and (letter[k] or letter[k + 1]) and (n > 2 or letter[k] or letter[k + 1]) and (n == 2 or letter[k + 1]):
                    code = int.from_bytes(data[k : k + n], "big") & 0xFFFFFFFF
                    yield (((code * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17

    for _, text, _ in rows[:20]:
        buckets = list(pieces(text))
        logits = np.mean([model.scores[b] for b in buckets], axis=0) + model.bias
        p = np.exp(logits / model.temperature - (logits / model.temperature).max())
        p /= p.sum()
        data = np.frombuffer(text.encode(), np.uint8)
        best, sure = model.predict(data, np.array([0, data.size]))
        assert best[0] == p.argmax() and abs(sure[0] - p.max()) < 1e-4
