import json

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.corpus import DOCUMENTS, TOKENS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions.ordinals import ORD, with_dense_order
from quarry.functions.tokenizers import BYTES
from quarry.operators import grouping, identifiers, joins, metrics, projections, sampling, semantic, tokens
from quarry.plans.pipeline import REGISTRY, PipelineConfig, compose, run
from quarry.plans.plugins import Param, Plugin, Registry
from quarry.sources import readers, sinks


def corpus(spark, n=20):
    d = spark.createDataFrame([(str(k), "document", f"text {k}", f"Title {k}" if k % 3 else " ", k) for k in range(n)], f"docid string, kind string, text string, title string, {ORD} long")
    q = spark.createDataFrame([(str(k % n), "query", f"q {k}", "", k) for k in range(3 * n)], d.schema)
    return Corpus({DOCUMENTS: d, TRAIN_QUERIES: q.where(f"{ORD} % 5 > 0"), VALIDATION_QUERIES: q.where(f"{ORD} % 5 = 0")})


def docs(spark, n):
    return spark.createDataFrame([(str(k), k) for k in range(n)], f"docid string, {ORD} long")


def test_corpus_rules(spark):
    c = corpus(spark)
    with pytest.raises(KeyError):
        c.replace(other=c[DOCUMENTS])
    with pytest.raises(ValueError):
        c.add(documents=c[DOCUMENTS])
    with pytest.raises(TypeError):
        c.merge(extra={"x": 1})
    with pytest.raises(ValueError):
        c.check_output(DOCUMENTS, (TRAIN_QUERIES,))
    with pytest.raises(ValueError):
        projections.require_package(c.without(DOCUMENTS))
    with pytest.raises(ValueError, match="nope"):
        projections.drop_columns(c, "nope", ignore_missing=False)


def test_dense_order_is_total(spark):
    rows = with_dense_order(spark.range(1000).repartition(7), [F.desc("id")], "n").collect()
    assert sorted(r.n for r in rows) == list(range(1000)) and all(r.id + r.n == 999 for r in rows)


def test_remap_needs_every_docid(spark):
    c = corpus(spark)
    mapping = identifiers.atomic_ids(c[DOCUMENTS])
    assert joins.assign_identifiers(c, mapping)[TRAIN_QUERIES].count() == c[TRAIN_QUERIES].count()
    with pytest.raises(Exception, match="docid without a new id"):
        joins.remap_docids(c[TRAIN_QUERIES], mapping.limit(3)).collect()


def test_validation_index_checks(spark):
    c = corpus(spark)
    assert joins.validation_index(c).columns == ["docid", "kind", "text"]
    with pytest.raises(ValueError, match="no document"):
        joins.validation_index(c.replace(documents=c[DOCUMENTS].limit(1)))


@pytest.mark.parametrize(("base", "length", "n"), [("01", 3, 8), ("01", 4, 11), ("abc", 3, 20)])
def test_hash_collisions_resolve_like_the_sequential_loop(spark, base, length, n):
    import hashlib

    taken, expected = set(), {}
    for k in range(n):
        salt = 0
        while True:
            value = int.from_bytes(hashlib.sha256(str(k).encode() + salt.to_bytes(8, "big")).digest()[:8], "big")
            code = ""
            for _ in range(length):
                code += base[value % len(base)]
                value //= len(base)
            if code not in taken:
                break
            salt += 1
        taken.add(code)
        expected[str(k)] = code
    got = identifiers.hash_ids(docs(spark, n), length, "custom", base)
    assert {r.old_docid: r.new_docid for r in got.collect()} == expected


def test_identifier_limits(spark):
    with pytest.raises(ValueError):
        identifiers.hash_ids(docs(spark, 9), 3, "custom", "01")
    with pytest.raises(ValueError):
        identifiers.naive_ids(docs(spark, 9), budget=3)
    with pytest.raises(ValueError):
        semantic.semantic_ids(docs(spark, 1).withColumn("vector", F.array(F.lit(1.0))), branching=11)
    assert identifiers.resolve_budget(10, 0, 1.25) == 13 and identifiers.resolve_budget(10, 0) == 10
    assert identifiers.atomic_ids(docs(spark, 0)).collect() == []
    assert sorted(r.new_docid for r in identifiers.atomic_ids(docs(spark, 11), start=95).collect())[-1] == "<doc_105>"


def test_exact_and_parallel_random_ids(spark):
    import random
    import uuid

    numbers = list(range(50))
    random.Random(3).shuffle(numbers)
    got = {r.old_docid: r.new_docid for r in identifiers.naive_ids(docs(spark, 20), 50, seed=3, exact=True).collect()}
    assert got == {str(k): str(numbers[k]) for k in range(20)}
    rng = random.Random(3)
    expected = {str(k): uuid.UUID(int=rng.getrandbits(128), version=4).hex for k in range(5)}
    assert {r.old_docid: r.new_docid for r in identifiers.uuid4_ids(docs(spark, 5), seed=3, exact=True).collect()} == expected
    hexes = {r.old_docid: r.new_docid for r in identifiers.uuid4_ids(docs(spark, 5)).collect()}
    ints = {r.old_docid: r.new_docid for r in identifiers.uuid4_ids(docs(spark, 5), "int").collect()}
    assert {k: str(int(v, 16)) for k, v in hexes.items()} == ints


def test_samplers(spark):
    c = corpus(spark)
    out = sampling.split_set(c, sampling.SplitSpec("s", 10, 5, True), 1, ORD)
    assert out[VALIDATION_QUERIES].count() == 5 and out[TRAIN_QUERIES].count() == 10
    assert not out[TRAIN_QUERIES].join(out[VALIDATION_QUERIES], "docid").take(1)
    assert out[DOCUMENTS].count() == 15
    assert sampling.split_set(c, sampling.SplitSpec("s", 0, 0), 1, ORD)[TRAIN_QUERIES].count() == 0
    assert sampling.split_set(c, sampling.SplitSpec("s", -1, -1), 1, ORD) is c
    with pytest.raises(ValueError):
        sampling.split_set(c, sampling.SplitSpec("s", -1, 3), 1, ORD)
    with pytest.raises(ValueError):
        sampling.check_size("x", c[DOCUMENTS], 3)
    with pytest.raises(ValueError):
        sampling.SamplingOptions(query_sampling="one-per-document", document_repeat=2)
    assert sampling.steps_per_epoch(101, 10, 2, 5) == 2 and sampling.warmup_steps(100, 3, 0, 0.1) == 30


def test_epochs_rotate_through_queries(spark):
    rows = spark.createDataFrame([("a", "document", "d")] + [("a", "query", f"q{k}") for k in range(3)], "docid string, kind string, key string")
    picked = [sampling.one_query_per_document(rows, e, 1, "key").where("kind = 'query'").first().key for e in range(6)]
    assert sorted(picked[:3]) == ["q0", "q1", "q2"] and picked[:3] == picked[3:]


def test_tokens(spark):
    df = spark.createDataFrame([("ab", "document"), ("x" * 40, "document")], "text string, kind string")
    got = [r[0] for r in df.select(tokens.text_tokens(F.col("text"), F.col("kind"))).collect()]
    assert got[0] == [100, 101, 1] and len(got[1]) == 33 and got[1][-1] == 1
    with pytest.raises(Exception, match="more than 3 tokens"):
        df.select(tokens.text_tokens(F.col("text"), F.lit("query"), query_max=3)).collect()
    chars = tokens.docid_tokens(spark.createDataFrame([("01",)], "docid string"), single_chars={"0": 7, "1": 8})
    assert chars.first().docid_tokens == [7, 8, 1]
    with pytest.raises(Exception, match="no single token"):
        tokens.docid_tokens(spark.createDataFrame([("02",)], "docid string"), single_chars={"0": 7}).collect()
    ids = F.array(*[F.lit(x) for x in (5, 6, 7, 1)])
    cut = spark.range(1).select(projections.truncate_query_ids(ids, None, 2, 1), projections.truncate_query_ids(ids, F.lit("document"), 2, 1), projections.truncate_query_ids(ids, None, 0, 1)).first()
    assert list(cut) == [[5, 6, 1], [5, 6, 7, 1], [5, 6, 7, 1]]
    assert BYTES.encode("a") == [100]


def test_metrics_with_duplicates_and_invalid(spark):
    p = spark.createDataFrame([(1, 1, "x"), (1, 2, "bad"), (1, 3, "x"), (1, 4, "g"), (2, 1, "bad")], "qid long, rank int, prediction string")
    gold = spark.createDataFrame([(1, "g"), (2, "y"), (3, "z")], "qid long, gold string")
    targets = spark.createDataFrame([("x",), ("g",), ("y",)], "target string")
    row = metrics.summarise(metrics.ranked_lists(p, gold, targets, 10), (1, 2), (10,), raw=True).first()
    assert row.n == 3 and row.hits_at_1 == 0 and row.hits_at_2 == pytest.approx(1 / 3) and row.mrr_at_10 == pytest.approx(1 / 6)
    assert row.raw_hits_at_2 == 0 and row.raw_mrr_at_10 == pytest.approx(1 / 12) and row.invalid_rate == pytest.approx(2 / 5)
    assert metrics.summarise(metrics.ranked_lists(p, gold.where("false"), targets, 10)).first().n == 0


def test_label_checks(spark):
    rows = spark.createDataFrame([("query", [300, 1, 1]), ("query", [301, 1, -100])], "kind string, labels array<int>")
    added = spark.createDataFrame([("a", 300), ("b", 301)], "token string, token_id int")
    assert grouping.atomic_targets(rows, added, 1).first().is_atomic
    assert not grouping.atomic_targets(rows, added.limit(1), 1).first().is_atomic
    assert not grouping.atomic_targets(rows.where("false"), added, 1).first().is_atomic
    assert grouping.longest_label([rows]).first()[0] == 3
    assert sorted(r[0] for r in grouping.first_label_ids(rows).collect()) == [300, 301]


def test_plugin_parameters():
    p = Plugin("dataset", "x", print, (Param("a", "int", 1), Param("b", "float", 0.5), Param("c", "str", "u", ("u", "v")), Param("d", "str")))
    assert p.resolve({"d": "z", "b": 2}) == {"a": 1, "b": 2.0, "c": "u", "d": "z"}
    for bad, error in (({}, ValueError), ({"d": "z", "e": 1}, ValueError), ({"d": "z", "a": True}, TypeError), ({"d": "z", "c": "w"}, ValueError)):
        with pytest.raises(error):
            p.resolve(bad)
    r = Registry()
    r.add(p)
    with pytest.raises(ValueError):
        r.add(p)
    assert "hash_baseN" in REGISTRY.describe()


def test_lines_and_judgements(spark):
    lines = readers.with_line_order(spark.createDataFrame([("1\ta\tb",), ("",), ("notab",), ("1\tlast",), ("2\tx",)], "value string").coalesce(1))
    assert {(r.qid, r.query) for r in readers.parse_query_lines(lines).collect()} == {("1", "last"), ("2", "x")}
    qrels = readers.parse_judgement_lines(spark.createDataFrame([("1 0 d1 1",), ("1\t0\td2\t0",), ("bad",)], "value string"))
    assert {tuple(r) for r in qrels.collect()} == {("1", "d1", 1), ("1", "d2", 0)}
    parsed = readers.parse_document_lines(spark.createDataFrame([("d1\tu\tt\tb\tc",), ("d2\tu\tt\t ",), ("d3",), ("d4\tu\tt\tb",)], "value string"))
    kept, counts = readers.active_documents(parsed, spark.createDataFrame([("d1",), ("d2",), ("d9",)], "docid string"))
    assert [tuple(r) for r in kept.collect()] == [("d1", "u", "t", "b\tc")]
    assert counts.first().asDict() == {"written": 1, "malformed": 1, "inactive": 1, "empty": 1, "missing": 1}


def test_layouts(spark):
    assert schemas.detect_layout(["document_text", "id", "document", "question"]) == "simple"
    with pytest.raises(ValueError):
        schemas.detect_layout(["x"])
    full = spark.createDataFrame([(1, [(0, 1, False, "a b"), (2, 3, True, "<P>")])], f"example_id long, document_tokens {schemas.TOKENS}")
    assert projections.simplify_questions(full).first().document_text == "a_b <P>"
    nested = json.dumps({
        "id": "5", "document": {"title": "t", "url": "u", "html": "h", "tokens": {"token": ["a"], "is_html": [False], "start_byte": [0], "end_byte": [1]}}, "question": {"text": "q", "tokens": ["q"]},
        "long_answer_candidates": {"start_token": [1, 2], "end_token": [3, 4], "top_level": [True, False]},
        "annotations": {"id": ["13591449469826568799"], "long_answer": [{"start_token": 1, "end_token": 2, "candidate_index": 0}], "short_answers": [{"start_token": [7], "end_token": [8]}], "yes_no_answer": [1]},
    })
    df = spark.createDataFrame([(nested,)], "value string").select(F.from_json("value", schemas.QUESTIONS_COLUMNAR).alias("r")).select("r.*")
    row = projections.columnar_questions(df).first()
    assert row.example_id == 5 and row.document_tokens[0].token == "a" and row.long_answer_candidates[1].start_token == 2
    assert int(row.annotations[0].annotation_id) == 13591449469826568799 and row.annotations[0].short_answers[0].end_token == 8 and row.annotations[0].yes_no_answer == "YES"


def test_pipeline_from_files_to_export(spark, tmp_path):
    for split, name in (("train", "train"), ("validation", "dev")):
        with open(f"{tmp_path}/{name}-simplified.jsonl", "w") as f:
            for k in range(12):
                n = k + (100 if split == "validation" else 0)
                f.write(json.dumps({"example_id": n, "question_text": f"q{n}", "document_url": f"http://x/?title=T_{k % 6}", "document_text": f"<H1> T{k % 6} </H1> <P> Body {k % 6} </P>"}) + "\n")
    config = PipelineConfig.from_dict(compose({
        "dataset": {"questions": {"data_source": str(tmp_path), "dedup_method": "title"}}, "identifier": "atomic", "augmentations": ["validation_index", "titles"],
        "transformations": ["tokenizer", "task_prefix_tokens", "multitask", {"drop_columns": {"columns": ["title"]}}], "export": {"disk_writer": {"path": f"{tmp_path}/out", "format": "jsonl"}},
    }, ["seed=7"]))
    assert config.seed == 7
    out = run(spark, config)["full"]
    assert out["train"].count() == 6 + 12 and out["validation"].count() == 12 and out[TOKENS].count() == 6 and out["titles"].count() == 6
    row = out["train"].where("kind = 'query'").first()
    assert row.labels[0] >= BYTES.vocab_size and row.labels[1] == 1 and row.input_ids[:6] == BYTES.encode("query:")
    meta = json.load(open(f"{tmp_path}/out/full/metadata.json"))
    assert meta["splits"]["train"]["rows"] == 18
    again = readers.read_export(spark, f"{tmp_path}/out/full", most_eval=3)
    assert again["train"].count() == 18 and again["validation"].count() == 3
    with pytest.raises(ValueError):
        PipelineConfig.from_dict({"dataset": "package", "nonsense": 1})


def test_package_round_trip_and_caches(spark, tmp_path):
    c = corpus(spark).map(lambda _, df: df.withColumn("source_ids", F.array("docid")).select("docid", "kind", "text", "title", "source_ids"))
    sinks.write_package(c, f"{tmp_path}/data/simplenorm/url", {"x": 1})
    back = readers.read_package(spark, str(tmp_path), "simplenorm-url", text_limit=4, lowercase=True)
    assert back[DOCUMENTS].count() == 20 and back[DOCUMENTS].first().text == "text"
    assert readers.package_path("r", "htmlnorm_infobox-nci-h1") == "r/data/htmlnorm-infobox/nci-h1"
    with pytest.raises(FileNotFoundError):
        readers.read_package(spark, str(tmp_path), "")
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert sinks.cached_stage(spark, sinks.stage_folder(str(tmp_path), 1), make).count() == 3
    assert calls == [1]
    key = sinks.cache_key("1", "titles", {}, 1, "s", dict(c.splits))
    for _ in range(2):
        augmented = sinks.cached_augmentation(f"{tmp_path}/aug", key, c.add(tokens=spark.range(1)), lambda x: x.add(extra=spark.range(2)))
        assert augmented["extra"].count() == 2 and TOKENS in augmented
    sinks.append_metrics(spark, {"a": float("nan")}, str(tmp_path), "j")
    sinks.append_metrics(spark, {"a": 1}, str(tmp_path), "j")
    assert spark.read.text(f"{tmp_path}/metrics_history.jsonl").count() == 2
    assert '"NaN"' in sinks.write_metrics(spark, {"m": float("nan")}, f"{tmp_path}/m.json")


def test_token_tables(spark, tmp_path):
    with open(f"{tmp_path}/t.jsonl", "w") as f:
        f.write('{"base_vocab_size": 10, "tokens": ["a", "b"]}\n{"base_vocab_size": 10, "token": "c"}\n')
    got = readers.read_token_table(spark, f"{tmp_path}/t.jsonl").orderBy("position").collect()
    assert [(r.token, r.position) for r in got] == [("a", 0), ("b", 1), ("c", 2)]
    assert readers.read_token_table(spark, f"{tmp_path}/none.jsonl").collect() == []
    with open(f"{tmp_path}/p.jsonl", "w") as f:
        f.write('{"token": "a", "payload": [1.0]}\n{"token": "a", "payload": [2.0]}\n')
    with pytest.raises(ValueError, match="twice"):
        readers.read_token_init(spark, f"{tmp_path}/p.jsonl")
    good = spark.createDataFrame([("a", [1.0, 2.0])], "token string, payload array<double>")
    ids = spark.createDataFrame([("a", 5)], "token string, token_id int")
    assert joins.resolve_token_init(good, ids, 2).first().token_id == 5
    with pytest.raises(Exception, match="cannot be initialised"):
        joins.resolve_token_init(good, ids, 3).collect()


def test_streams(spark, tmp_path):
    from quarry.streaming import incremental

    spark.createDataFrame([("a", 1), ("A", 2), ("b", 3)], "text string, v long").withColumn("ts", F.timestamp_seconds(F.col("v"))).write.parquet(f"{tmp_path}/in")
    stream = incremental.arriving(spark, f"{tmp_path}/in", "text string, v long, ts timestamp")
    first = incremental.first_of_key(stream, F.col("text"), "ts", "1 hour")
    first.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_stats_table(spark):
    shown = grouping.render_stats(grouping.corpus_stats({"full": corpus(spark)}))
    assert "20" in shown and "48" in shown and "12" in shown


def test_whole_queries_cut_nothing(spark):
    from quarry.plans import catalogue

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    expected = {}
    for k, x in texts.items():
        if k + 1 in texts:
            y = texts[k + 1]
            expected[k] = None if x == y else next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    got = {r.doc_id: r.first_difference for r in catalogue.QUERIES["first_differences_whole"](spark, sf).collect()}
    assert got == expected and any(min(len(texts[k]), len(texts[k + 1])) >= 300 for k in got)


def test_limits_of_the_reference(spark):
    from quarry.plans import catalogue

    sf = "/root/testdata/sf0.001"
    assert max(r.n_chars for r in catalogue.QUERIES["question_rows"](spark, sf).collect()) > 500
    assert max(len(r.ids.split(",")) for r in catalogue.QUERIES["task_prefix"](spark, sf).collect()) == len("index:") + 32 + 1


def test_products_meet_all_rows_in_blocks(spark):
    import numpy as np

    from quarry.functions import vectors

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    x[70] = x[3]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r.qid: r.ids for r in vectors.nearest_products(rows.where("id % 7 = 0"), rows, 4, block=5, chunk=11).collect()}
    assert got == {k: sorted(range(90), key=lambda t: (-sum(a * b for a, b in zip(x[k], x[t])), t))[:4] for k in range(0, 90, 7)}


def test_the_first_pair_of_equal_six_digit_codes_is_told_apart(spark):
    """The least pair of numbers whose first codes are equal: the later one takes its next salt."""
    df = spark.createDataFrame([("125203", 125203), ("211202", 211202)], "docid string, _ord long")
    first = {r.docid: r.code for r in df.select("docid", identifiers.hash_code(F.col("docid"), F.lit(0), identifiers.ALPHABETS["base64_urlsafe"], 6).alias("code")).collect()}
    assert first["125203"] == first["211202"]
    made = {r.old_docid: r.new_docid for r in identifiers.hash_ids(df, length=6).collect()}
    assert made["125203"] == first["125203"] != made["211202"]


def test_ranked_lists_are_dealt_by_their_number(spark, monkeypatch):
    """Many predictions go to more tasks than the session's, and the lists stay the same."""
    predictions = spark.createDataFrame([(f"q{k % 40}", k // 40, f" t{(k * 7) % 23}") for k in range(400)], "qid string, rank int, prediction string")
    gold = spark.createDataFrame([(f"q{k}", f"t{k % 23}") for k in range(42)], "qid string, gold string")
    targets = spark.createDataFrame([(f"t{k}",) for k in range(0, 23, 2)], "target string")
    few = metrics.ranked_lists(predictions, gold, targets, 5)
    monkeypatch.setattr(metrics, "TASK_ROWS", 30)
    many = metrics.ranked_lists(predictions, gold, targets, 5)
    assert "RepartitionByExpression [qid" not in few._jdf.queryExecution().optimizedPlan().toString()
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [qid") >= 2 and ", 14" in plan
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


@pytest.mark.parametrize(("base", "length", "n"), [("0123456789abcdef", 2, 256), ("abc", 4, 81)])
def test_full_spaces_of_codes_settle_in_tens_of_rounds(spark, base, length, n):
    """The last documents need hundreds of salts, which once took a round each."""
    import hashlib

    expected, most = {}, 0
    for k in range(n):
        salt = -1
        code = None
        while code is None or code in expected:
            salt += 1
            value = int.from_bytes(hashlib.sha256(str(k).encode() + salt.to_bytes(8, "big")).digest()[:8], "big")
            code = "".join(base[value // len(base) ** p % len(base)] for p in range(length))
        expected[code] = str(k)
        most = max(most, salt)
    assert most > 40
    got = identifiers.hash_ids(docs(spark, n), length, "custom", base, most_rounds=40)
    assert {r.new_docid: r.old_docid for r in got.collect()} == expected
