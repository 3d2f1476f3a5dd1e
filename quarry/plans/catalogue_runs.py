"""Registered queries of runs and their caches, of evaluations, and of lists and files too long for one row or one task.

What they write lies in the shared folder and is made from whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, Corpus
from quarry.operators import grouping, joins, projections
from quarry.plans import evaluate, tables
from quarry.plans.catalogue import _PAIRS, _RANKED, query
from quarry.plans.pipeline import PipelineConfig, Runner
from quarry.plans.tables import table
from quarry.sources import fingerprints, prepared, sinks
from quarry.storage import new_path, write_bytes


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("""
SELECT 1 AS call, true AS made, count(*) AS n_titles FROM customer UNION ALL SELECT 2, false, count(*) FROM customer
UNION ALL SELECT 3, true, count(*) + (SELECT count(*) FROM supplier) FROM customer UNION ALL SELECT 4, false, count(*) + (SELECT count(*) FROM supplier) FROM customer
""")
def changed_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An augmentation whose input at one path changes between the second and the third call: made, found, made again, found."""
    source, root = new_path(spark, "augmented-input"), new_path(spark, "augmentations")
    rows = lambda name, key, title: table(spark, sf_dir, name).select(F.col(key).cast("string").alias("docid"), F.col(title).alias("title"))
    rows("customer", "c_custkey", "c_name").write.parquet(source)
    out, made = [], []

    def make(corpus: Corpus) -> Corpus:
        made.append(True)
        return corpus.merge(extra={"titles": projections.titles_split(corpus[DOCUMENTS])})

    for call in (1, 2, 3, 4):
        if call == 3:
            rows("supplier", "s_suppkey", "s_name").write.mode("append").parquet(source)
        corpus, before = Corpus({DOCUMENTS: spark.read.parquet(source)}), len(made)
        key = sinks.cache_key("1", "titles", {}, 42, "default", dict(corpus.splits))
        done = sinks.cached_augmentation(root, key, corpus, make)
        out.append(done["titles"].agg(F.count("*").alias("n_titles")).select(F.lit(call).alias("call"), F.lit(len(made) > before).alias("made"), "n_titles"))
    return _union(out)


@query("""
WITH f AS (SELECT * FROM (VALUES ('as written', 1), ('copied in other files', 1), ('unchanged', 1), ('one value changed', 2)) t(state, version))
SELECT f.state, f.version, (SELECT count(*) FROM customer) AS n_rows FROM f
""")
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files: the same for the same rows however they are dealt, another once one value is another."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("x").alias("mark"))
    known = fingerprints.Fingerprints(spark, new_path(spark, "fingerprints"))
    one, two, three = (new_path(spark, f"rows-{k}") for k in range(3))
    rows.write.json(one)
    rows.repartition(3, "c_custkey").write.json(two)
    least = F.col("c_custkey") == F.lit(rows.agg(F.min("c_custkey")).first()[0])
    rows.withColumn("mark", F.when(least, "y").otherwise(F.col("mark"))).write.json(three)
    states = {"as written": one, "copied in other files": two, "unchanged": one, "one value changed": three}
    digests = {name: known.of(path) for name, path in states.items()}
    numbers = {d: k + 1 for k, d in enumerate(dict.fromkeys(digests.values()))}
    counted = [spark.read.text(path).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("state"), F.lit(numbers[digests[name]]).alias("version"), "n_rows") for name, path in states.items()]
    return _union(counted)


@query("""
WITH n AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) AS rows),
s AS (SELECT * FROM (VALUES ('first', 6, true), ('same again', 0, false), ('other prefix', 3, true), ('other source', 6, true)) t(run, executed, has_jobs))
SELECT run, CAST(executed AS INTEGER) AS executed, has_jobs, CASE run WHEN 'other source' THEN n.rows + 1 ELSE n.rows END AS train_rows FROM s, n
""")
def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration four times: all steps run, none, those from the changed parameter on, and all once the source has changed."""
    source, cache = new_path(spark, "package"), new_path(spark, "runs")
    corpus = tables.customers(spark, sf_dir).map(lambda _, df: df.withColumn("source_ids", F.array("docid")).select("docid", "kind", "text", "title", "source_ids"))
    sinks.write_package(corpus, source)
    steps = {"dataset": {"package": {"data_source": source}}, "identifier": "identity", "augmentations": "titles", "transformations": {"tokenizer": {"query_max_length": 64}, "multitask": {}}, "cache_dir": cache}
    out = []
    for run, limit in (("first", 32), ("same again", 32), ("other prefix", 16), ("other source", 16)):
        if run == "other source":
            more = corpus[DOCUMENTS].limit(1).withColumn("docid", F.lit("one more"))
            sinks.write_package(corpus.replace(documents=corpus[DOCUMENTS].unionByName(more)), source)
        body = json.loads(json.dumps(steps))
        body["transformations"]["tokenizer"]["document_max_length"] = limit
        body["export"] = {"disk_writer": {"path": f"{cache}/out-{limit}", "format": "parquet"}}
        runner = Runner(spark, PipelineConfig.from_dict(body))
        train = runner.run()["full"]["train"]
        executed = [s for s in runner.report.steps if not s.reused]
        out.append(train.agg(F.count("*").alias("train_rows")).select(F.lit(run).alias("run"), F.lit(len(executed)).alias("executed"), F.lit(runner.report.jobs() > 0).alias("has_jobs"), "train_rows"))
    return _union(out)


@query("""
SELECT s.split, s.found, s.then_found, count(*) AS n_rows FROM customer,
(VALUES ('good', 'reused', 'reused'), ('cut', 'damaged', 'reused'), ('without titles', 'lacks nci_dedup_title', 'reused'), ('none', 'missing', 'reused')) s(split, found, then_found) GROUP BY ALL
""")
def prepared_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared splits that are whole, cut in a gzip file, without a needed field, and not there; all are whole when asked again."""
    layout = "example_id BIGINT, document_text STRING, nci_dedup_title STRING"
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("example_id"), F.col("c_name").alias("document_text"), F.col("c_mktsegment").alias("nci_dedup_title"))
    root = new_path(spark, "prepared")
    paths = {name: f"{root}/{name.replace(' ', '-')}.jsonl.gz" for name in ("good", "cut", "without titles", "none")}
    for name in ("good", "cut"):
        prepared.commit(spark, rows, paths[name])
    prepared.commit(spark, rows.drop("nci_dedup_title"), paths["without titles"])
    whole = spark.read.format("binaryFile").load(paths["cut"]).where("length > 0").orderBy("path").select("path", "content").first()  # one file
    write_bytes(spark, whole["path"], bytes(whole["content"])[:-5])
    out = []
    for name, path in paths.items():
        found = [prepared.prepared_split(spark, path, lambda: rows, ("nci_dedup_title",), layout) for _ in range(2)]
        counted = found[1][0].agg(F.count("nci_dedup_title").alias("n_rows"))
        out.append(counted.select(F.lit(name).alias("split"), F.lit(found[0][1]).alias("found"), F.lit(found[1][1]).alias("then_found"), "n_rows"))
    return _union(out)


def _measures(rank: str, prefix: str = "") -> str:
    total = lambda value: f"round(sum(CASE WHEN {rank} <= k THEN {value} ELSE 0 END) / count(*), 6)"
    return f"{total('CAST(1 AS DOUBLE)')} AS {prefix}hits, {total(f'CAST(1 AS DOUBLE) / {rank}')} AS {prefix}mrr"


@query(_RANKED.rstrip() + """,
b AS (SELECT l.*, CASE WHEN gold IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') THEN 'seen' ELSE 'unseen' END AS seen FROM l),
e AS (SELECT b.*, t.bucket, c.k FROM b, (VALUES (1), (5), (10)) c(k), LATERAL (SELECT unnest(['all', b.seen]) AS bucket) t),
s AS (SELECT bucket, k, count(*) AS n, """ + f"{_measures('rank')}, {_measures('raw_rank', 'raw_')}" + """,
             round(sum(n_invalid) / sum(n_predictions), 6) AS invalid_rate FROM e GROUP BY bucket, k)
SELECT g.bucket, CAST(c.k AS INTEGER) AS k, coalesce(s.n, 0) AS n, coalesce(hits, 0.0) AS hits, coalesce(mrr, 0.0) AS mrr, coalesce(raw_hits, 0.0) AS raw_hits, coalesce(raw_mrr, 0.0) AS raw_mrr,
       coalesce(invalid_rate, 0.0) AS invalid_rate, true AS logged
FROM (VALUES ('all'), ('seen'), ('unseen')) g(bucket), (VALUES (1), (5), (10)) c(k) LEFT JOIN s ON s.bucket = g.bucket AND s.k = c.k
""")  # fmt: skip
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries of an export, their parts as predictions, large parts as targets: all buckets and cut-offs, and what was logged."""
    predictions, gold, targets = tables.rankings(spark, sf_dir)
    ids = F.array(F.lit(1))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").cast("string").alias("docid"), F.lit("query").alias("kind"))
    layout = lambda df, qid: df.select("kind", "docid", ids.alias("input_ids"), ids.alias("labels"), qid.cast("string").alias("qid"))
    folder = new_path(spark, "evaluated")
    train = layout(lines, F.lit(None))
    validation = layout(gold.select(F.lit("query").alias("kind"), F.col("gold").alias("docid"), F.col("qid").alias("_q")), F.col("_q"))
    sinks.export(Corpus({"train": train, "validation": validation}), folder)
    predictions.select(F.col("qid").cast("string").alias("qid"), "rank", "prediction").write.parquet(f"{folder}/predictions")
    log = f"{folder}/metrics.json"
    tokens = targets.select(F.col("target").alias("token"))
    out = evaluate.evaluate(spark, f"{folder}/default", spark.read.parquet(f"{folder}/predictions"), tokens, output=log, history=folder)
    back = json.loads("\n".join(r[0] for r in spark.read.text(log).collect()))  # one small file
    logged = back == sinks.json_safe(evaluate.named(out)) and spark.read.text(f"{folder}/metrics_history.jsonl").count() == 1
    rounded = [F.round(c, 6).alias(c) for c in evaluate.MEASURES]
    return out.select("bucket", "k", "n", *rounded, F.lit(logged).alias("logged"))


@query("""
WITH s AS (SELECT lang, coalesce(source, 'none') || '.' || doc_id % 97 AS s, min(doc_id) AS o FROM documents GROUP BY ALL),
p AS (SELECT lang, s, row_number() OVER (PARTITION BY lang ORDER BY o, s) - 1 AS place FROM s)
SELECT lang, place // 25 AS page, string_agg(s, ',' ORDER BY place) AS source_ids FROM p GROUP BY ALL
""")
def source_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each language's documents in pages of 25."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws(".", F.coalesce("source", F.lit("none")), (F.col("doc_id") % 97).cast("string")).alias("s"))
    return grouping.source_id_pages(rows, ["lang"], "doc_id", "s", 25).select("lang", "page", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"""
WITH p AS ({_PAIRS}), r AS (SELECT p.qid AS query_id, p.docid, o_orderpriority AS text FROM p JOIN part ON p_partkey = docid AND p_size > 10 JOIN orders ON o_orderkey = qid)
SELECT query_id, docid, text, row_number() OVER (ORDER BY query_id, docid) - 1 AS place FROM r
""")
def sorted_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query rows written in order over range-partitioned files, and read back in their places by the manifest."""
    documents = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("docid"))
    queries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("query"))
    rows = joins.query_rows(joins.judged_pairs(tables.judgements(spark, sf_dir), documents), queries)
    path = new_path(spark, "sorted")
    sinks.write_sorted(rows, path, ["query_id", "docid"])
    return sinks.read_sorted(spark, path).select("query_id", "docid", "text", "place")


@query("""
WITH f AS (SELECT source, md5(text) AS m, min(doc_id) AS o FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o) AS r FROM f)
SELECT a.source, a.m AS text_a, b.m AS text_b FROM r a JOIN r b ON a.source IS NOT DISTINCT FROM b.source AND a.r = 1 AND b.r = 2
""")
def first_two_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two different texts of each source."""
    out = grouping.extreme_texts(table(spark, sf_dir, "documents"), ["source"], "text", "doc_id", "first")
    return out.select("source", F.md5("text_a").alias("text_a"), F.md5("text_b").alias("text_b"))
