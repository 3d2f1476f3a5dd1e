"""Fill-in-the-middle against plain Python, row by row."""

import hashlib
import random
import re

import pytest

from quarry.llm import fill_in_middle as fim
from tests.llm.fixtures import AWKWARD, documents, empty, prose


def plainly(doc_id, text, cut=90, suffix_first=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def found(df):
    return sorted(((r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, repr(r[1])))


def texts():
    rng = random.Random(5)
    units = ["a", "Zz", " ", "\n", "é", "漢", "😀", "1", "<", "<P", "S>", "<S>", "<M>", "word", "\x00", "\r\n", "'", "́"]
    return AWKWARD + [prose(rng, rng.randint(1, 400)) for _ in range(60)] + ["".join(rng.choice(units) for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["é" * k for k in (1, 63, 64, 65, 127, 128, 129)]


def test_every_row_is_cut_as_plain_python_cuts_it(spark):
    given = texts()
    out = found(fim.rearrange(documents(spark, given).repartition(3)))
    assert out == [(k, plainly(k, t)) for k, t in enumerate(given)]
    assert {r[1][1] for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("run_bytes", [1, 300])
def test_runs_of_any_length_give_the_same(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(fim, "RUN_BYTES", run_bytes)
    given = texts()[-120:]
    batches = list(fim._runs(documents(spark, given).select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]))
    assert sum(b.num_rows for b in batches) == len(given) and len(batches) > 5
    assert found(fim.rearrange(documents(spark, given).coalesce(1))) == [(k, plainly(k, t)) for k, t in enumerate(given)]


def test_texts_come_back(spark):
    given = texts()
    out = fim.rearrange(documents(spark, given))
    back = {r[0]: r[1] for r in out.select("doc_id", fim.restored("output", "form")).collect()}
    assert back == {k: t or "" for k, t in enumerate(given)}


def test_digests_are_those_of_the_texts(spark):
    given = texts()[:40]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in fim.digests(documents(spark, given)).collect():
        want = plainly(r["doc_id"], given[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (*want[:4], sha(want[4]), sha(given[r["doc_id"]] or ""))


def test_shares_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "some text"), (None, "some text"), (7, "b c"), (7, "b c"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert found(fim.rearrange(df)) == sorted(((d, plainly(d, t)) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, repr(r[1])))
    assert fim.rearrange(empty(spark)).collect() == []
    all_cut = fim.rearrange(documents(spark, ["x y z"] * 50), cut_percent=100, suffix_first_percent=100)
    assert {r["form"] for r in all_cut.collect()} == {"spm"}
    assert {r["form"] for r in fim.rearrange(documents(spark, ["x y z"] * 50), cut_percent=0).collect()} == {"plain"}
