import itertools
import random
import re

import numpy as np

from quarry.llm import near_duplicates
from quarry.llm.components import components
from tests.llm.fixtures import AWKWARD, documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(texts, size):
    sets = {k: shingles(t, size) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def edited(rng, text, share):
    words = text.split()
    for k in rng.sample(range(len(words)), int(len(words) * share)):
        words[k] = f"e{rng.random()}"
    return " ".join(words)


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    texts = list(AWKWARD)
    for _ in range(12):
        base = prose(rng, rng.choice([20, 80, 300]))
        texts += [base, base.upper(), base.replace(" ", "\n\t")]
        texts += [edited(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.08)]
    texts += [prose(rng, 60) for _ in range(40)]
    rng.shuffle(texts)
    for size in (4, 5):
        expected = brute(dict(enumerate(texts)), size)
        rows = near_duplicates.group(documents(spark, texts).repartition(3), size).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_group_of_small_changes_without_its_original(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [edited(rng, base, s) for s in (0.015, 0.02, 0.03) for _ in range(60)]
    expected = brute(dict(enumerate(texts)), 5)
    rows = near_duplicates.group(documents(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: v[1] for k, v in expected.items()}


def test_keep_one_and_empty(spark):
    docs = documents(spark, ["a b c d e f g"] * 3 + [None, "", "other words stand here today you see"])
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert near_duplicates.group(empty(spark)).collect() == []
    assert near_duplicates.keep_one(empty(spark)).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (130, 100)]
    got = dict((r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).distinct().collect())
    assert {v for k, v in got.items() if k <= 40} == {0} and {v for k, v in got.items() if k >= 100} == {100}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1400).astype(np.uint64)
    a, b = np.sort(pool[:1200]), np.sort(pool[200:])
    agree = (np.frombuffer(near_duplicates.sketch(a), np.uint8) == np.frombuffer(near_duplicates.sketch(b), np.uint8)).mean()
    assert abs(agree - 1000 / 1400) < 0.06
