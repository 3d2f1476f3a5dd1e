"""Runs that resume, caches that notice changes, probes of damaged files, plugins from other packages, evaluation, paged lists."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.operators import grouping
from quarry.plans import evaluate, graph, plugins
from quarry.plans.pipeline import PipelineConfig, Runner
from quarry.plans.plugins import Param, Plugin, Registry
from quarry.sources import fingerprints, prepared, sinks


def collection(folder, n=12):
    for split, name in (("train", "train"), ("validation", "dev")):
        with open(f"{folder}/{name}-simplified.jsonl", "w") as f:
            for k in range(n):
                i = k + (100 if split == "validation" else 0)
                f.write(json.dumps({"example_id": i, "question_text": f"q{i}", "document_url": f"http://x/?title=T_{k % 6}", "document_text": f"<H1> T{k % 6} </H1> <P> Body {k % 6} </P>"}) + "\n")


def config(folder, cache, **changes):
    body = {
        "dataset": {"questions": {"data_source": str(folder), "dedup_method": "title"}}, "identifier": "atomic", "augmentations": ["validation_index", "titles"],
        "transformations": {"tokenizer": {}, "multitask": {}, "drop_columns": {"columns": ["title"]}}, "cache_dir": cache,
    }
    body.update(changes)
    return PipelineConfig.from_dict(body)


def test_runs_resume_at_the_first_changed_step(spark, tmp_path):
    (tmp_path / "in").mkdir()
    collection(tmp_path / "in")
    cache = str(tmp_path / "cache")

    def done(c):
        runner = Runner(spark, c)
        out = runner.run()["full"]
        return runner.report, sorted(tuple(r) for r in out["train"].select("kind", F.array_join("input_ids", ","), F.array_join("labels", ",")).collect())

    first, rows = done(config(tmp_path / "in", cache))
    assert [s.name for s in first.steps] == ["dataset:questions", "identifier:atomic", "augmentation:validation_index", "augmentation:titles", "transformation:tokenizer", "transformation:multitask", "transformation:drop_columns"]
    assert all(s.jobs > 0 for s in first.steps)
    again, same = done(config(tmp_path / "in", cache))
    assert again.executed() == [] and again.jobs() == 0 and same == rows
    changed, _ = done(config(tmp_path / "in", cache, transformations={"tokenizer": {"document_max_length": 3}, "multitask": {}, "drop_columns": {"columns": ["title"]}}))
    assert changed.executed() == ["transformation:tokenizer", "transformation:multitask", "transformation:drop_columns"]
    uncached, plain = done(config(tmp_path / "in", ""))
    assert plain == rows and len(uncached.executed()) == 7
    collection(tmp_path / "in", 13)
    fresh, more = done(config(tmp_path / "in", cache))
    assert len(fresh.executed()) == 7 and len(more) == len(rows) + 1
    # A result whose manifest is not there is not trusted.
    (tmp_path / "cache" / "steps" / fresh.steps[-1].digest / "complete.json").unlink()
    assert done(config(tmp_path / "in", cache))[0].executed() == ["transformation:drop_columns"]


def test_sections_run_in_the_order_of_the_mapping(tmp_path):
    c = PipelineConfig.from_dict({"dataset": "package", "transformations": {"tokenizer": {}, "none": {}}, "augmentations": {"titles": None}, "export": ["package", {"disk_writer": {"path": "x"}}], "identifier": "none"})
    assert [f"{k}:{s.plugin}" for k, s in c.steps] == ["dataset:package", "transformation:tokenizer", "augmentation:titles", "export:package", "export:disk_writer"]
    usual = PipelineConfig.from_dict({"dataset": "package"})
    assert [k for k, _ in usual.steps] == ["dataset", "identifier", "augmentation", *["transformation"] * 4]
    assert c.digest() != usual.digest()
    for bad in ({"identifier": "identity"}, {"identifier": "identity", "dataset": "package"}, {"dataset": "package", "augmentations": 3}, {"dataset": {"package": "x"}}, {"dataset": "package", "other": 1}):
        with pytest.raises(ValueError):
            PipelineConfig.from_dict(bad)


def test_every_step_is_checked(spark):
    registry = Registry()
    good = Corpus({s: spark.createDataFrame([("1", 0)], "docid string, _ord long") for s in (DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES)})
    registry.add(Plugin("dataset", "good", lambda spark: good))
    registry.add(Plugin("dataset", "bad", lambda spark: [1]))
    registry.add(Plugin("augmentation", "bad", lambda corpus, seed: corpus[DOCUMENTS]))
    registry.add(Plugin("transformation", "bad", lambda corpus: Corpus({DOCUMENTS: "no table"})))
    none = {"identifier": "none", "augmentations": "none", "transformations": "none"}
    assert set(Runner(spark, PipelineConfig.from_dict({"dataset": "good", **none}), registry).run()["full"]) == set(good)
    for body, message in (({"dataset": "bad"}, "no corpus"), ({"dataset": "good", "augmentations": "bad"}, "augmentation:bad returned DataFrame"), ({"dataset": "good", "transformations": "bad"}, "no DataFrames")):
        with pytest.raises(TypeError, match=message):
            Runner(spark, PipelineConfig.from_dict({"dataset": "", **none, **body}), registry).run()
    with pytest.raises(TypeError):
        graph.checked("x", {})


def test_fingerprints_follow_content(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, "b", None), (2, "b", None)], "k int, x string, y string")
    digest = fingerprints.content(df)
    assert fingerprints.content(df.repartition(3)) == digest
    assert fingerprints.content(df.distinct()) != digest
    assert fingerprints.content(df.select("k", F.col("y").alias("x"), F.col("x").alias("y"))) != digest
    assert fingerprints.content(df.withColumn("k", F.col("k").cast("long"))) != digest
    known = fingerprints.Fingerprints(spark, str(tmp_path / "k"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    with gzip.open(tmp_path / "d" / "b.jsonl.gz", "wt") as f:
        f.write('{"a": 3}\n')
    spark.range(5).write.parquet(str(tmp_path / "d" / "t.parquet"))
    path = str(tmp_path / "d")
    one = known.of(path)
    n_known = spark.read.parquet(known.table).count()
    assert known.of(path) == one and spark.read.parquet(known.table).count() == n_known
    (tmp_path / "d" / "a.jsonl").write_text('{"a": 2}\n{"a": 1}\n')
    assert known.of(path) == one and spark.read.parquet(known.table).count() == n_known + 1  # read again, the same rows
    (tmp_path / "d" / "c.jsonl").write_text("")
    assert known.of(path) == one
    (tmp_path / "d" / "c.jsonl").write_text("x\n")
    assert known.of(path) != one
    assert known.of(str(tmp_path / "none")) == known.of(str(tmp_path / "none2"))


def test_probes_find_damage(spark, tmp_path):
    body = b"".join(json.dumps({"a": k, "b": "x" * 200}).encode() + b"\n" for k in range(9000))
    whole = gzip.compress(body)
    cases = {
        "good.gz": whole, "two.gz": whole + gzip.compress(b'{"a": 1}\n'), "cut.gz": whole[:-9], "half.gz": whole[: len(whole) // 2], "flipped.gz": whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:],
        "plain.gz": body[:100], "open.jsonl": body[:-1], "good.jsonl": body, "text.jsonl": b"no json\n", "empty.jsonl": b"",
    }
    folder = tmp_path / "split"
    folder.mkdir()
    for name, data in cases.items():
        (folder / name).write_bytes(data)
    found = {r["path"].rpartition("/")[2]: r for r in prepared.probe(spark, str(folder)).collect()}
    assert {n for n, r in found.items() if r["damage"] is None} == {"good.gz", "two.gz", "good.jsonl"}  # an empty file is not listed
    assert found["good.gz"]["n_lines"] == 9000 and found["two.gz"]["n_lines"] == 9001 and found["good.gz"]["fields"] == ["a", "b"]
    assert found["cut.gz"]["damage"] == "cut short" and found["half.gz"]["damage"] == "cut short"


def test_prepared_splits_of_the_questions_plugin(spark, tmp_path):
    collection(tmp_path)
    body = {"dataset": {"questions": {"data_source": str(tmp_path), "dedup_method": "ncititle", "prepared_cache": True}}, "identifier": "none", "augmentations": "none", "transformations": "none"}
    run = lambda: sorted(tuple(r) for r in Runner(spark, PipelineConfig.from_dict(body)).run()["full"][TRAIN_QUERIES].select("docid", "text").collect())
    first = run()
    folder = tmp_path / "train-simplenorm.prepared.jsonl.gz"
    assert folder.is_dir() and run() == first
    part = next(folder.glob("part-*.gz"))
    part.write_bytes(part.read_bytes()[:-4])
    assert prepared.fault(spark, str(folder)) == "damaged"
    assert run() == first and prepared.fault(spark, str(folder), ("nci_dedup_title",)) is None
    assert not list(tmp_path.glob("*.staged-*"))


def package(tmp_path, name, body, points):
    root = tmp_path / f"site-{name}"
    (root / name).mkdir(parents=True)
    (root / name / "__init__.py").write_text("")
    (root / name / "helper.py").write_text("def shout(s):\n    return s.upper() + '!'\n")
    (root / name / "plugin.py").write_text(body)
    info = root / f"{name}-1.dist-info"
    info.mkdir()
    (info / "METADATA").write_text(f"Metadata-Version: 2.1\nName: {name}\nVersion: 1\n")
    (info / "entry_points.txt").write_text("[quarry.plugins]\n" + "".join(f"{k} = {name}.plugin:{v}\n" for k, v in points.items()))
    return str(root)


BODY = """
from quarry.plans.plugins import Param, Plugin

def run(corpus, suffix):
    def shouted(batches):
        from shouting.helper import shout
        for pdf in batches:
            yield pdf.assign(docid=[shout(d) + suffix for d in pdf["docid"]])
    return corpus.map(lambda _, df: df.mapInPandas(shouted, df.schema))

SHOUT = Plugin("transformation", "shout", run, (Param("suffix", "str", "?"),))

def many():
    return [Plugin("transformation", "whisper", run, ()), Plugin("export", "nowhere", lambda c, s: None)]

WRONG = 3
"""


def test_plugins_of_other_packages_run_inside_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(package(tmp_path, "shouting", BODY, {"a": "SHOUT", "b": "many"}))
    registry = Registry()
    found = plugins.discover(registry, spark)
    assert [p.name for p in found] == ["shout", "whisper", "nowhere"] and registry.names("transformation") == ["shout", "whisper"]
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "docid string, _ord long")
    registry.add(Plugin("dataset", "two", lambda spark: Corpus({s: rows for s in (DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES)})))
    body = {"dataset": "two", "identifier": "none", "augmentations": "none", "transformations": {"shout": {"suffix": "1"}}}
    out = Runner(spark, PipelineConfig.from_dict(body), registry).run()["full"]
    assert {r["docid"] for r in out[DOCUMENTS].collect()} == {"A!1", "B!1"}
    with pytest.raises(ValueError, match="twice"):
        plugins.discover(registry)
    with pytest.raises(ValueError, match="no parameter"):
        Runner(spark, PipelineConfig.from_dict({**body, "transformations": {"shout": {"sufix": "1"}}}), registry)


def test_plugins_of_wrong_shapes_are_refused(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(package(tmp_path, "wrongly", BODY, {"w": "WRONG"}))
    with pytest.raises(TypeError, match="no Plugin"):
        plugins.discover(Registry())
    for bad in (lambda: Plugin("dataset", "", print), lambda: Plugin("dataset", "none", print), lambda: Plugin("dataset", "x", print, ("a",)), lambda: Plugin("dataset", "x", print, (Param("a"), Param("a")))):
        with pytest.raises((TypeError, ValueError)):
            bad()
    with pytest.raises(ValueError):
        Registry().add(Plugin("verb", "x", print))


def test_evaluation_from_files(spark, tmp_path):
    layout = "kind string, docid string, input_ids array<int>, labels array<int>, qid string"
    train = spark.createDataFrame([("query", " d1 ", [1], [1], None), ("document", "d9", [1], [1], None)], layout)
    held = spark.createDataFrame([("query", "d1", [1], [1], "a"), ("query", "d2", [1], [1], "b"), ("query", "d3", [1], [1], "c")], layout)
    sinks.export(Corpus({"train": train, "validation": held}), str(tmp_path))
    said = spark.createDataFrame([("a", 1, "d1"), ("b", 1, "nonsense"), ("b", 2, "d9"), ("b", 3, "d2"), ("b", 4, "d2")], "qid string, rank int, prediction string")
    rows = {(r["bucket"], r["k"]): r for r in evaluate.evaluate(spark, f"{tmp_path}/default", said, ks=(1, 2), output=f"{tmp_path}/m.json", history=str(tmp_path)).collect()}
    assert [rows[b, 1]["n"] for b in evaluate.BUCKETS] == [3, 1, 2]
    assert rows["seen", 1]["hits"] == 1 and rows["unseen", 1]["hits"] == 0 and rows["unseen", 2]["hits"] == 0.5 and rows["unseen", 2]["mrr"] == 0.25 and rows["unseen", 2]["raw_hits"] == 0
    assert rows["all", 1]["invalid_rate"] == 1 / 5 and rows["all", 1]["hits"] == pytest.approx(1 / 3)
    assert json.load(open(f"{tmp_path}/m.json"))["eval_seen_hits_at_1"] == 1
    nobody = evaluate.evaluate(spark, f"{tmp_path}/default", said.where("false"), ks=(1,)).collect()
    assert {(r["bucket"], r["n"], r["hits"], r["invalid_rate"]) for r in nobody} == {("all", 3, 0, 0), ("seen", 1, 0, 0), ("unseen", 2, 0, 0)}
    with pytest.raises(FileNotFoundError):
        evaluate.evaluate(spark, f"{tmp_path}/default", said, split="test")
    sinks.export(Corpus({"validation": held.withColumn("qid", F.lit(None).cast("string"))}), f"{tmp_path}/no")
    with pytest.raises(ValueError, match="qid"):
        evaluate.evaluate(spark, f"{tmp_path}/no/default", said)


def test_evaluation_is_one_pass(spark):
    lists = spark.createDataFrame([("a", "g", 1, 0, 1, 1, "seen")], "qid string, gold string, n_predictions int, n_invalid int, rank int, raw_rank int, bucket string")
    plan = evaluate.report(lists, (1, 5, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Generate") == 1 and plan.count("Aggregate") == 1


def test_pages_of_sources_and_a_hot_key(spark):
    rows = [("hot" if k % 2 else f"k{k % 7}", f"s{k % 900}", k) for k in range(3000)] + [(None, "n", 1), (None, "m", 0)]
    df = spark.createDataFrame(rows, "key string, s string, o long").repartition(5)
    want = {}
    for key, s, o in sorted(rows, key=lambda r: r[2]):
        want.setdefault(key, dict())[s] = None
    pages = {(r["key"], r["page"]): r["source_ids"] for r in grouping.source_id_pages(df, ["key"], "o", "s", 40).collect()}
    assert max(len(p) for p in pages.values()) == 40
    for key, sources in want.items():
        mine = [x for (k, _), p in sorted(((q, p) for q, p in pages.items() if q[0] == key), key=lambda z: z[0][1]) for x in p]
        assert mine == list(sources)
    docs, _ = grouping.group_by_key(df, F.col("key"), F.col("o"), F.col("s"), ["s"])
    assert "source_ids" not in docs.columns
    with pytest.raises(ValueError):
        grouping.source_id_pages(df, ["key"], "o", "s", 0)


def test_texts_are_fetched_for_winners_only(spark):
    rows = [(k % 3, "x" * (50 - k % 11) + str(k % 5), k) for k in range(60)] + [(None, "only", 99), (9, None, 100)]
    df = spark.createDataFrame(rows, "key int, text string, o long").repartition(3)
    for mode in ("extremes", "first"):
        for most in (100_000, 0):
            got = {r["key"]: (r["text_a"], r["text_b"]) for r in grouping.extreme_texts(df, ["key"], "text", "o", mode, most).collect()}
            for key in (0, 1, 2):
                mine = [t for k, t, _ in rows if k == key]
                if mode == "extremes":
                    assert got[key] == (min(mine, key=len), max(mine, key=len))
                else:
                    assert got[key] == (mine[0], next(t for t in mine if t != mine[0]))
            assert (None in got) == (mode == "extremes")
    seen = []
    real = grouping.materialise
    try:
        grouping.materialise = lambda frame, label: seen.append(frame._jdf.queryExecution().executedPlan().toString()) or real(frame, label)
        grouping.extreme_texts(df, ["key"], "text", "o").collect()
    finally:
        grouping.materialise = real
    below = [line for line in seen[0].splitlines() if "Exchange hashpartitioning" in line]
    assert below and "text#" not in "".join(line.split("Project")[0] for line in seen[0].splitlines() if "HashAggregate" in line and "partial" not in line)


def test_sorted_files_are_read_by_their_manifest(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").cast("string").alias("v")).repartition(6)
    path = str(tmp_path / "s")
    manifest = sinks.write_sorted(df, path, ["k"], 8)
    assert manifest.count() == 8
    rows = sinks.read_sorted(spark, path)
    assert sorted((r["place"], r["k"]) for r in rows.collect()) == [(k, k) for k in range(5000)]
    assert "Sort" not in rows._jdf.queryExecution().optimizedPlan().toString()
    some = sinks.read_sorted(spark, path, (1000,), (1200,))
    assert len(some.inputFiles()) <= 2 and {r["k"] for r in some.where("k between 1000 and 1200").collect()} == set(range(1000, 1201))
    assert all(r["place"] == r["k"] for r in some.collect())
    assert sinks.read_sorted(spark, path, (9000,)).collect() == []


def test_ragged_tables_leave_gaps():
    from quarry.operators import html_tree as tree

    cell = lambda rows, columns=1: tree.Cell(False, "x", columns, rows, [])
    a, b, c, d, e = cell(1), cell(1), cell(2), cell(1), cell(2, 2)
    assert tree.spread([[a, b, c], [d]]) == [[a, b, c], [d, None, c]]
    assert tree.spread([[e, a], [b]]) == [[e, e, a], [e, e, b]]
    assert tree.spread([[], [a]]) == [[a]]
