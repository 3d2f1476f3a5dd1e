"""The tree of semantic identifiers: the same however the work is cut, and as a plain recursion makes it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.ordinals import ORD
from quarry.operators import semantic


def table(spark, x, partitions=3):
    rows = [(f"d{k}", k, [float(c) for c in v]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, f"docid string, {ORD} long, vector array<double>").repartition(partitions)


def ids(df):
    return {r.old_docid: r.new_docid for r in df.collect()}


def plain_kmeans(x, h, k, seed, restarts, most_steps):
    """Lloyd with lists and Python integers."""
    rows = [[int(c) for c in v] for v in x]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))

    def drawn(centres, *salts):
        key = semantic.noise(h, *salts)
        if centres:
            key = key + np.log(np.maximum(np.array([float(min(far(v, c) for c in centres)) for v in rows]), 1e-300))
        return list(rows[max(range(len(rows)), key=lambda i: (key[i], h[i]))])

    best = None
    for r in range(restarts):
        centres, before = [], None
        for c in range(k):
            centres.append(drawn(centres, seed, r, 0, c))
        for step in range(1, most_steps + 1):
            labels = [min(range(k), key=lambda c: (far(v, centres[c]), c)) for v in rows]
            inertia = sum(far(v, centres[c]) >> semantic.INERTIA_SHIFT for v, c in zip(rows, labels))
            if labels == before:
                break
            before, now = labels, []
            for c in range(k):
                mine = [v for v, a in zip(rows, labels) if a == c]
                now.append([(2 * sum(col) + len(mine)) // (2 * len(mine)) for col in zip(*mine)] if mine else drawn([], seed, r, step, c))
            centres = now
        if best is None or inertia < best[0]:
            best = inertia, labels
    return best[1]


def plain_tree(x, h, branching, max_leaf, seed, restarts, most_steps):
    out = {}

    def go(at, prefix, seed):
        if len(at) <= max_leaf:
            out.update({f"d{i}": f"{prefix}{place}" for place, i in enumerate(at)})
            return
        k = min(branching, len(at))
        labels = plain_kmeans(x[at], h[at], k, seed, restarts, most_steps)
        if len(set(labels)) == 1:
            labels = [i % k for i in range(len(at))]
        for c in sorted(set(labels)):
            go([i for i, a in zip(at, labels) if a == c], f"{prefix}{c}", semantic.next_seed(seed, c))

    go(list(range(len(x))), "", seed)
    return out


@pytest.mark.parametrize("kind", ["random", "copies", "equal"])
def test_tree_is_that_of_a_plain_recursion(spark, kind):
    rng = np.random.default_rng(1)
    x = {"random": rng.normal(size=(120, 4)), "copies": rng.integers(0, 2, (120, 3)).astype(float) + 1, "equal": np.ones((60, 3))}[kind]
    df = table(spark, x)
    ints, _ = semantic.as_integers(df, True)
    made = {r["docid"]: (r["x"], r["h"]) for r in ints.collect()}
    xi, h = np.array([made[f"d{k}"][0] for k in range(len(x))], float), np.array([made[f"d{k}"][1] for k in range(len(x))])
    want = plain_tree(xi, h, 3, 12, 7, 2, 20)
    for node_rows in (12, 1000):
        assert ids(semantic.semantic_ids(df, 3, 12, 7, 2, 20, node_rows=node_rows)) == want


def test_ids_do_not_depend_on_how_the_work_is_cut(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 8)), np.tile(rng.normal(size=(1, 8)), (250, 1)), rng.normal(size=(50, 8)) + 6])
    found = []
    for partitions, node_rows, most_nodes in ((1, 10_000, 500), (40, 10_000, 500), (1, 60, 500), (9, 60, 2)):
        found.append(ids(semantic.semantic_ids(table(spark, x, partitions), 4, 20, restarts=2, most_steps=30, node_rows=node_rows, most_nodes=most_nodes)))
    assert all(f == found[0] for f in found)
    assert len(set(found[0].values())) == len(x) == len(found[0])


def test_a_far_row_gets_a_branch_of_its_own(spark):
    x = [[1.0, 0.001 * (k % 3)] if k != 617 else [-1.0, 0.0] for k in range(1000)]
    made = ids(semantic.semantic_ids(table(spark, x), 2, 100, restarts=2, most_steps=5, node_rows=600))
    assert len(set(made.values())) == 1000 and sum(v[0] == made["d617"][0] for v in made.values()) == 1


def test_near_vectors_share_prefixes_and_scales_do_no_harm(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 16)) * 5
    x = np.concatenate([c + 0.01 * rng.normal(size=(50, 16)) for c in centres])
    for scale, normalise in ((1.0, True), (1e-6, False), (1e6, False)):
        made = ids(semantic.semantic_ids(table(spark, x * scale), 4, 60, normalise=normalise))
        first = [{made[f"d{k}"][0] for k in range(50 * c, 50 * c + 50)} for c in range(4)]
        assert all(len(s) == 1 for s in first) and len(set.union(*first)) == 4


def test_empty_zero_and_bad_vectors(spark):
    assert ids(semantic.semantic_ids(table(spark, [[1.0]]).where("false"))) == {}
    assert len(set(ids(semantic.semantic_ids(table(spark, [[0.0, 0.0]] * 30), 3, 5)).values())) == 30
    df = table(spark, [[1.0, 2.0]] * 3)
    for bad in (df.withColumn("vector", F.array(F.lit(None).cast("double"))), df.withColumn("vector", F.when(F.col(ORD) == 1, F.array(F.lit(1.0))).otherwise(F.col("vector"))), df.withColumn("vector", F.lit(None).cast("array<double>"))):
        with pytest.raises(ValueError):
            semantic.semantic_ids(bad)


def test_nodes_of_a_quarter_are_finished_by_a_task(spark, monkeypatch):
    """Only the root of a large table takes a job for each step; the ids are those of any other cut."""
    x = np.random.default_rng(5).normal(size=(400, 6))
    seen, plain = [], semantic._cluster_large
    monkeypatch.setattr(semantic, "_cluster_large", lambda rows, nodes, *rest: (seen.append([n.prefix for n in nodes]), plain(rows, nodes, *rest)))
    want = ids(semantic.semantic_ids(table(spark, x), 10, 20, restarts=1, most_steps=4, node_rows=1000))
    assert seen == []
    monkeypatch.setattr(semantic, "NODE_ROWS", 20)
    assert ids(semantic.semantic_ids(table(spark, x), 10, 20, restarts=1, most_steps=4)) == want
    assert seen == [[""]]
