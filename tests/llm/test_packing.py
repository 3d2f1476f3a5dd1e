import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import packing
from tests.llm.fixtures import AWKWARD, documents, empty, prose


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = reference_ids.__dict__.setdefault("t", Tokenizer.from_file(packing.default_tokenizer()))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check(rows, texts, capacity=packing.CAPACITY):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for k, text in texts.items():
        ids = np.array(reference_ids(text), "<u4")
        at = 0
        for r in sorted(pieces.pop(k), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == ids.size and r.length > 0
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == ids.size
    assert not pieces
    padding = 0
    for window in sequences.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(sequences)


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(1)
    texts = dict(enumerate([*AWKWARD, *[prose(rng, rng.choice([1, 5, 40, 300, 3000])) for _ in range(60)]]))
    rows = packing.pack(documents(spark, list(texts.values())).repartition(3)).collect()
    padding, n = check(rows, texts)
    assert padding == 0


def test_empty_table_and_repeated_rows(spark):
    assert packing.pack(empty(spark)).collect() == []
    docs = documents(spark, ["a b c"])
    assert packing.pack(docs.unionAll(docs)).count() == 2


def test_level_minimises_squares():
    p = packing.SumOfSquares(10)
    for level, n in ((3, 4), (6, 1), (8, 2)):
        p.levels[level] = n
    for size in range(1, 10):
        costs = {}
        for level in [0, 3, 6, 8]:
            if level + size > 10:
                continue
            counts = p.levels.copy()
            if level:
                counts[level] -= 1
            if level + size < 10:
                counts[level + size] += 1
            costs[level] = int((counts[1:10] ** 2).sum())
        best = min(costs.values())
        assert costs[p.level_for(size)] == best


@pytest.mark.parametrize("capacity", [8, 64])
def test_online_packer_conserves(capacity):
    rng = random.Random(capacity)
    p, total, closed = packing.SumOfSquares(capacity), 0, []
    for k in range(300):
        size = rng.randint(1, 3 * capacity)
        total += size
        closed += p.add(k, b"\0\0\0\0" * size)
    full = len(closed)
    closed += p.finish()
    assert sum(len(x[2]) // 4 for w in closed for x in w) == total
    assert all(sum(len(x[2]) // 4 for x in w) == capacity for w in closed[:full])
    sizes = [sum(len(x[2]) // 4 for x in w) for w in closed[full:]]
    assert all(s & (s - 1) == 0 or s == capacity for s in sizes)


def closed_by_the_rule(sizes, packers):
    """(windows filled by the rule, by what follows at a packer's end, documents cut) of documents dealt to packers."""
    rule, rest, cut = 0, 0, set()
    for p in range(packers):
        packer, windows = packing.SumOfSquares(), []
        for k, size in enumerate(sizes[p::packers]):
            windows += packer.add((p, k), b"\0\0\0\0" * size)
        rule += len(windows)
        windows += packer.finish()
        rest += len(windows)
        seen = Counter(piece[0] for w in windows for piece in w)
        cut |= {d for d, n in seen.items() if n > 1}
    return rule, rest - rule, len(cut)


def test_the_rule_closes_windows_however_finely_the_input_is_cut(spark, monkeypatch):
    """Documents of all 32 partitions meet in one packer, in which the rule closes most windows and few documents are cut."""
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 5, 40])) for _ in range(120)]
    one = packing.pack(documents(spark, texts).repartition(32)).collect()
    assert {r.sequence_id >> 40 for r in one} == {0}
    many = packing.pack(documents(spark, texts).repartition(32), packer_tokens=400).collect()
    assert len({r.sequence_id >> 40 for r in many}) > 3
    assert check(many, dict(enumerate(texts)))[0] == 0
    sizes = [min(40_000, int(rng.lognormvariate(5.8, 1.3)) + 1) for _ in range(12_000)]
    long = sum(s > packing.CAPACITY for s in sizes)
    rule, rest, cut = closed_by_the_rule(sizes, 1)
    assert rule >= 0.8 * (rule + rest) and cut <= 1.2 * long
    finely = closed_by_the_rule(sizes, 32)
    assert finely[0] < rule
    assert "MOST_OPEN" not in dir(packing)
