"""Product codes against plain Python integers; the tree search against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm import vector_codes as vc


def plainly(rows, parts, entries, rounds):
    """rows (vec_id, vector, label) -> {vec_id: (code, error, label_error)}, digest. Ids are different here."""
    kept = sorted((i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, v: min(range(len(books[p])), key=lambda e: (apart(books[p][e], cut(v, p)), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(best(p, v), []).append(cut(v, p))
            for e, vs in mine.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    codes = {i: ([best(p, v) for p in range(parts)], label, v) for i, v, label in kept}
    errors = {i: sum(apart(books[p][c[p]], cut(v, p)) for p in range(parts)) for i, (c, _, v) in codes.items()}
    of_label = {}
    for i, (_, label, _) in codes.items():
        of_label[label] = of_label.get(label, 0) + errors[i]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return {i: ("".join(f"{x:02x}" for x in c), errors[i], of_label[label]) for i, (c, label, _) in codes.items()}, hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", [1]) for r in rows], "vec_id long, embedding array<float>, label int, ints string, error array<int>")


def vectors(n, d, seed=1, coarse=False):
    rng = random.Random(seed)
    one = lambda: float(np.float32(rng.choice([0.0, 1 / 256, -1 / 256]) if coarse else rng.gauss(0, 1)))
    return [(3 * k, [one() for _ in range(d)], rng.choice([None, 1, 2, 2, 2])) for k in range(n)]


AWKWARD = [(1, None, 1), (4, [None] + [1.0] * 7, 1), (7, [float("nan")] + [1.0] * 7, None), (10, [1.0] * 7 + [float("inf")], 2), (13, [float("-inf")] + [0.0] * 7, 2)]


@pytest.mark.parametrize(("n", "parts", "entries", "rounds", "coarse"), [(300, 4, 16, 2, False), (300, 2, 40, 3, True), (5, 4, 16, 2, False), (120, 8, 64, 0, False)])
def test_codes_are_those_of_plain_python(spark, n, parts, entries, rounds, coarse):
    """With ties (coarse vectors), with fewer rows than entries, and with rows that don't count."""
    rows = AWKWARD + vectors(n, 8, coarse=coarse)
    random.Random(2).shuffle(rows)
    want, digest = plainly(rows, parts, entries, rounds)
    for most_labels in (100, 1):
        got = vc.compress(table(spark, rows).repartition(3), parts=parts, entries=entries, rounds=rounds, most_labels=most_labels).collect()
        assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want
        assert {r["codebooks_sha256"] for r in got} == {digest}


def test_tree_search_visits_equal_bounds():
    rng = np.random.default_rng(4)
    for spread in (2, 5, 1000):
        for n in (1, 3, 64, 200):
            entries, x = rng.integers(-spread, spread, (n, 3)), rng.integers(-2 * spread, 2 * spread, (500, 3))
            apart = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
            for leaf in (1, 8):
                at, best = vc.nearest(vc.kd_tree(entries, leaf=leaf), x)
                assert (at == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_search_passes_over_far_nodes(monkeypatch):
    entries = np.arange(64)[:, None] * 1000
    looked = []
    node = vc.kd_tree(entries)
    real = np.maximum
    monkeypatch.setattr(vc.np, "maximum", lambda a, b: looked.append(len(a)) or real(a, b))
    vc.nearest(node, np.array([[31_000]]))
    monkeypatch.undo()
    assert sum(looked) < 2 * 15  # two calls for each node; a full tree has fifteen nodes


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (None, [0.25] * 8, None), (2, [-0.001] * 8, 1)]
    got = vc.compress(table(spark, rows), parts=4, entries=3).collect()
    # Of the two equal first entries only the lower is used in the first round, takes up the null id's row and leaves its own.
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == [(0, "00000000", 0, 0), (1, "01010101", 0, 0), (1, "01010101", 0, 0), (2, "02020202", 0, 0)]
    assert vc.compress(table(spark, [(1, None, 1)])).collect() == []
    assert vc.fit(vc.whole_vectors(table(spark, rows).where("false"))).digest() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vc.compress(table(spark, [(1, [0.5] * 7, 1)]), parts=4)
    with pytest.raises(Exception, match="components"):
        vc.compress(table(spark, [(k, [0.5] * (8 if k < 64 else 4), 1) for k in range(70)]), parts=4).collect()


def test_codes_do_not_depend_on_partitions_and_decode(spark):
    rows = vectors(400, 8)
    found = [sorted(map(tuple, vc.compress(table(spark, rows).repartition(n), parts=4, entries=16).collect())) for n in (1, 6)]
    assert found[0] == found[1]
    ints = vc.whole_vectors(table(spark, rows))
    books = vc.fit(ints, 4, 16)
    by_id = {r["vec_id"]: r for r in vc.encode(ints, books).collect()}
    for r in ints.take(20):
        back = vc.decode([by_id[r["vec_id"]]["code"]], books)["vector"][0]
        assert sum((a - b) ** 2 for a, b in zip(back, r["ints"])) == by_id[r["vec_id"]]["error"]
