import hashlib
import random
import re

from quarry.llm import decontaminate
from tests.llm.fixtures import AWKWARD, documents, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    found = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            found.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    sizes = {len(k) for k in found}
    out = {}
    for k, t in texts.items():
        w, hit, names = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (i := found.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    names |= i
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[k] = (len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def tables(spark):
    rng = random.Random(2)
    items = [(k, prose(rng, rng.choice([3, 12, 13, 30]), 300)) for k in range(20)] + [(20, None), (21, ""), (22, "two words"), (23, "the the the the"), (10, "shared again")]
    texts = list(AWKWARD)
    for _ in range(60):
        body = prose(rng, rng.choice([5, 60, 400]), 300).split()
        for _ in range(rng.choice([0, 1, 2])):
            passage = (items[rng.randrange(20)][1]).split()
            cut = rng.randrange(len(passage)) if rng.random() < 0.3 else 0
            at = rng.randrange(len(body))
            body[at:at] = passage[cut:]
        texts.append(" ".join(body))
    texts += ["Two; WORDS two words", "the " * 50, None]
    return texts, items, spark.createDataFrame(items, "item_id long, text string")


def test_judgement_matches_brute_force(spark, monkeypatch):
    texts, items, bench = tables(spark)
    expected = brute(dict(enumerate(texts)), items)
    for block in (decontaminate.BLOCK, 40):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        rows = decontaminate.judge(documents(spark, texts).repartition(3), bench).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == expected
    assert any(v[4] for v in expected.values())


def test_repeated_rows_empty_tables_and_filter(spark):
    texts, items, bench = tables(spark)
    docs = documents(spark, texts)
    assert decontaminate.judge(docs.unionAll(docs), bench).count() == 2 * len(texts)
    assert decontaminate.judge(empty(spark), bench).collect() == []
    assert not decontaminate.judge(docs, bench.where("false")).where("n_hit > 0").take(1)
    clean = decontaminate.drop_contaminated(docs, bench)
    expected = brute(dict(enumerate(texts)), items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [k for k, v in expected.items() if not v[4]]


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "rareone common raretwo")], "item_id long, text string")
    docs = documents(spark, ["x rareone common y z raretwo", "rareone common " + "x " * 30 + "raretwo", "rareone common raretwo", "common common common", "raretwo", "rareone common"])
    shards = decontaminate.index(docs)
    assert [(r.doc_id, r.item_id, r.start, r.length) for r in decontaminate.search(shards, bench).collect()] == [(2, "1", 0, 3)]
    assert sorted({r.doc_id for r in decontaminate.search(shards, bench, slack=3).collect()}) == [0, 2]


def test_one_index_serves_several_benchmarks(spark):
    texts, items, bench = tables(spark)
    shards = decontaminate.index(documents(spark, texts).repartition(3))
    found = decontaminate.search(shards, bench).select("doc_id", "item_id").distinct().count()
    parts = [decontaminate.search(shards, bench.where(c)).select("doc_id", "item_id") for c in ("item_id % 2 = 0", "item_id % 2 = 1")]
    assert 0 < found == parts[0].unionByName(parts[1]).distinct().count()


def test_a_million_windows_are_one_block(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    items = [(str(k), rng.integers(0, 1 << 62, 1012).astype(np.uint64)) for k in range(1000)]
    asked = decontaminate.Asked.of(items)
    assert asked.start.size == 1_000_000 and asked.words.size <= decontaminate.BLOCK
    hit = items[7][1][100:120]
    h = np.concatenate([hit, hit[:5]])
    order = np.argsort(h, kind="stable")
    terms, first = np.unique(h, return_index=False), np.searchsorted(np.sort(h), np.unique(h))
    shard = {"terms": terms.tobytes(), "first": np.append(first, h.size).astype(np.int32).tobytes(), "positions": order.astype(np.uint32).tobytes(), "base": np.zeros(1, np.int64).tobytes()}
    found = [(asked.item[w], s) for ws, ss in decontaminate._found(shard, asked, 0) for w, s in zip(ws, ss)]
    assert sorted(found) == [(7, k) for k in range(8)]


def test_a_frequent_item_is_one_row_a_document(spark):
    """A one-word item that stands everywhere: runs, not occurrences, leave a shard, and blocks are united."""
    bench = spark.createDataFrame([(1, "the"), (2, "the cat"), (3, "cat sat"), (4, "dog")], "item_id long, text string")
    docs = documents(spark, ["the " * 3000, "the cat sat on the mat", "dog", "no hit", "the x " * 1000, "cat sat the cat"])
    shards = decontaminate.index(docs.coalesce(1))
    assert decontaminate.search(shards, bench).where("doc_id = 0").count() == 3000
    found = {r.doc_id: ([tuple(s) for s in r.spans], sorted(r.items)) for r in decontaminate.hits(shards, bench).collect()}
    assert found[0] == ([(0, 3000)], ["1"]) and found[1] == ([(0, 3), (4, 1)], ["1", "2", "3"]) and found[2] == ([(0, 1)], ["4"])
    assert len(found[4][0]) == 1000 and found[5] == ([(0, 4)], ["1", "2", "3"]) and set(found) == {0, 1, 2, 4, 5}


def test_blocks_are_united(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 1)
    bench = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "z")], "item_id long, text string")
    rows = decontaminate.judge(documents(spark, ["a b c", "x z", "a c"]), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in rows] == [(3, 3, 2), (2, 1, 1), (2, 0, 0)]
