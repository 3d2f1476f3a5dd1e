import random
import re
import shutil

import corpus_pipeline
from tests.llm.fixtures import documents, prose
from tests.llm.test_decontaminate import brute as brute_contaminated
from tests.llm.test_near_duplicates import brute as brute_groups
from tests.llm.test_packing import check
from tests.llm.test_pii import brute as brute_spans


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts, toxic = [], []
    for k in range(300):
        text, bad = prose(rng, rng.choice([30, 90])), k % 5 == 1
        texts.append(text + (" snargle you frobnit snargle" if bad else ""))
        toxic.append(int(bad))
    items = [(k, prose(rng, 20)) for k in range(5)]
    texts += [texts[0], texts[2] + " more", items[0][1] + " tail", f"write a.b@c.de or 4111 1111 1111 1111 {prose(rng, 20)}", None, ""]
    toxic += [0] * 6
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, v) for k, v in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    at, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        at = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = {r.doc_id: r.text for r in at.collect()}

    whole = dict(enumerate(texts))
    assert {k for k, v in enumerate(toxic) if not v} - kept["toxicity"].keys() == set()
    assert len(kept["toxicity"]) <= len([v for v in toxic if not v]) + 3
    groups = brute_groups(kept["toxicity"], 5)
    assert kept["near_duplicates"].keys() == {k for k, (_, g) in groups.items() if g == k}
    judged = brute_contaminated(kept["near_duplicates"], items)
    assert kept["decontamination"].keys() == {k for k, v in judged.items() if not v[4]}
    assert kept["personal_data"].keys() == kept["decontamination"].keys()
    for k, text in kept["personal_data"].items():
        assert brute_spans(text) == [] and (text == whole[k] or brute_spans(whole[k]))
    packed = corpus_pipeline.pack(spark, at, str(tmp_path)).collect()
    assert check(packed, kept["personal_data"])[0] == 0
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in run if r.doc_tokens <= 4096 and r.start == 0 and r.length == r.doc_tokens)
    assert {r.doc_id for r in run} == kept["personal_data"].keys()
    shutil.rmtree(tmp_path)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = documents(spark, ["x"]).where("false")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert re.match("^None$", str(corpus_pipeline.ORACLE_SQL))
