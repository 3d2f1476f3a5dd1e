"""Line dedup against plain Python, and its filters against sets."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import line_dedup as ld
from quarry.llm.words import text_slices
from tests.llm.fixtures import AWKWARD, documents, empty, prose

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plainly(rows, least, keep="none"):
    """(doc_id, n_lines, n_dropped, kept) of rows (doc_id, text)."""
    lines = [(t or "").split("\n") for _, t in rows]
    counts = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    first = {}
    for (doc, _), ls in sorted(zip(rows, lines), key=lambda x: x[0][0]):
        for place, line in enumerate(ls):
            first.setdefault(key(line), (doc, place))
    out = []
    for (doc, _), ls in zip(rows, lines):
        stay = [x for k, x in enumerate(ls) if counts[key(x)] < least or (keep == "first" and first[key(x)] == (doc, k))]
        out.append((doc, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out)


def texts():
    rng = random.Random(3)
    pool = ["License text", "  license TEXT\t", "share this", "", "  ", "É", "é", "menu", "Menu", "a\x1cb", "漢字", "x", "once and again"]
    one = lambda: rng.choice(pool) if rng.random() < 0.6 else prose(rng, rng.randint(1, 6))
    return AWKWARD + ["\n".join(one() for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["\n", "\n\n", "menu\n", "\nmenu", "menu\nmenu\nmenu", "menu"]


def found(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("least", "keep", "more"), [(10, "none", {}), (2, "none", {}), (3, "first", {}), (3, "none", {"most_keys": 0}), (3, "first", {"most_keys": 0}), (10, "none", {"bits": 64})])
def test_lines_go_as_in_plain_python(spark, least, keep, more):
    """By broadcast hashes, by a join, and with a filter that is so small that it suspects every line."""
    given = texts()
    got = found(ld.drop_repeated(documents(spark, given).repartition(5), least, keep, **more))
    assert got == plainly(list(enumerate(given)), least, keep)
    assert sum(r[2] for r in got) > 20


def test_twice_filter_holds_all_that_two_documents_share_and_little_else(spark, monkeypatch):
    given = texts()
    whole = found(ld.drop_repeated(documents(spark, given), 2))
    bits = 1 << 16
    for pages, most in ((1 << 18, 1 << 22), (256, 50)):
        monkeypatch.setattr(ld, "PAGE_BITS", pages)
        monkeypatch.setattr(ld, "MOST_POSITIONS", most)
        filled = ld.twice_filter(documents(spark, given).repartition(4), bits)
        counts = Counter(k for t in given for k in {key(x) for x in (t or "").split("\n")} if k)
        suspected = {r["key"] for r in ld.suspects(documents(spark, given), filled, bits).collect()}
        shared = {k for k, n in counts.items() if n > 1}
        assert shared <= suspected and len(suspected - shared) < 0.02 * len(counts)
        assert found(ld.drop_repeated(documents(spark, given).repartition(4), 2, bits=bits)) == whole


def test_lines_of_a_slice():
    given = [t or "" for t in texts()]
    k = 0
    for lo, hi, data, offsets in text_slices(pa.array(given), 500):
        lines = ld.Lines(data, offsets)
        for t in range(hi - lo):
            want = given[k].split("\n")
            mine = range(lines.first[t], lines.first[t + 1])
            assert [data[lines.starts[i] : lines.ends[i]].tobytes().decode() for i in mine] == want
            assert [lines.key(i).decode() for i in mine] == [key(x) for x in want]
            assert {lines.key(i).decode() for i in lines.each_once() if lines.text[i] == t} == {key(x) for x in want if key(x)}
            k += 1
    assert k == len(given)


def test_equal_hashes_of_different_lines_are_told_apart(spark):
    """A hash that stands for two keys, of which one goes: the text decides."""
    lines = ld.Lines(np.frombuffer(b"menu", np.uint8), np.array([0, 4]))
    h = int(lines.hashes[0].view(np.int64))
    df = documents(spark, ["Menu\nown"] * 3)
    for keys, want in (({b"menu"}, "own"), ({b"another key"}, "Menu\nown")):
        out = ld._by_hash(df, np.array([h]), None, {h: frozenset(keys)})
        assert {r["kept"] for r in out.collect()} == {want}


def test_repeated_rows_hot_lines_and_empty_tables(spark):
    """A row is a document; a line in a third of all rows is one row for each task where it is counted."""
    rows = [(1, "only here\ntwice"), (1, "only here\ntwice"), (None, "hot"), *[(k, f"hot\nown {k}") for k in range(2, 400)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {(r["doc_id"], r["kept"]) for r in ld.drop_repeated(df, 2).collect()}
    assert got == {(1, ""), (None, ""), *((k, f"own {k}") for k in range(2, 400))}
    assert ld.drop_repeated(empty(spark)).collect() == []
    assert [(r["n_lines"], r["n_dropped"], r["kept"]) for r in ld.drop_repeated(documents(spark, [None])).collect()] == [(1, 0, "")]
    with pytest.raises(ValueError):
        ld.drop_repeated(df, 1)
