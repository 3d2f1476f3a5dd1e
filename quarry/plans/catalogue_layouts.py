"""Registered queries of row layouts, conversions, scans, sinks, checks and HTML rendering, each with its SQL.

Scans and sinks run on what the query itself writes to the shared folder, from whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions import keys, text, vectors
from quarry.functions.ordinals import ORD
from quarry.functions.tokenizers import BYTES
from quarry.operators import grouping, html_tree, joins, projections, sampling, tokens
from quarry.plans import tables
from quarry.plans.catalogue import _IDS, query
from quarry.plans.tables import table
from quarry.schemas import detect_layout
from quarry.sources import readers, sinks
from quarry.storage import new_path


def _joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",")


# --- rows and layouts


@query("SELECT doc_id AS example_id, 'query' AS kind, md5(split_part(text, chr(10), 1)) AS text_md5, '' AS title, CAST(doc_id AS VARCHAR) AS source_id FROM documents")
def question_query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.examples(spark, sf_dir).select("example_id", *projections.question_query("question_text", "example_id"))
    return rows.select("example_id", "kind", F.md5("text").alias("text_md5"), "title", F.col("source_ids")[0].alias("source_id"))


@query("SELECT conv_id, turn, md5(lower(text)) AS text_md5 FROM conversations")
def ranking_query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", projections.ranking_query("text")).select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, text FROM documents")
def dropped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of answers are gone, the others are whole."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("annotations"), F.col("source").alias("long_answer_candidates"))
    return projections.drop_answers(rows)


_CUSTOMER_TEXTS = """
c AS (SELECT 'documents' AS split, CAST(c_custkey AS VARCHAR) AS docid, concat_ws(' ', c_name, c_mktsegment) AS text FROM customer UNION ALL
      SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'validation_queries' ELSE 'train_queries' END, CAST(o_custkey AS VARCHAR), concat_ws(' ', o_orderpriority, o_orderkey) FROM orders)
"""


def _all_splits(corpus: Corpus, *columns: str | Column) -> DataFrame:
    out = None
    for name in corpus:
        part = corpus[name].select(F.lit(name).alias("split"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_CUSTOMER_TEXTS} SELECT split, docid, array_to_string(list_append(CASE WHEN split = 'documents' THEN list_slice({_IDS.format(x='text')}, 1, 12) ELSE {_IDS.format(x='text')} END, 1), ',') AS input_ids, array_to_string(list_append({_IDS.format(x='docid')}, 1), ',') AS labels FROM c")
def tokenised_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splits tokenised, under the names that training reads."""
    out = projections.rename_token_columns(tokens.tokenise(tables.customers(spark, sf_dir), document_max=12))
    return _all_splits(out, "docid", _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels"))


@query(f"WITH {_CUSTOMER_TEXTS} SELECT split, docid, CASE WHEN split = 'documents' THEN substr(text, 1, 8) ELSE text END AS text FROM c")
def rewritten_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as their token ids give them back."""
    return _all_splits(tokens.tokenise(tables.customers(spark, sf_dir), document_max=8, rewrite_text=True), "docid", "text")


@query(f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '5,6,1' WHEN 1 THEN '7,1' ELSE array_to_string(list_append({_IDS.format(x='c_name')}, 1), ',') END AS ids FROM customer")
def kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that are there already are only closed; empty ones are made."""
    own = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(5), F.lit(6))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit(7), F.lit(1))).otherwise(F.array().cast("array<int>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", tokens.text_tokens(F.col("c_name"), F.lit("document"), existing=own).alias("ids"))
    return rows.select("c_custkey", _joined("ids").alias("ids"))


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of a wiki: a URL with an encoded title, and a text with heading, paragraph and lists."""
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("https://w.example/index.php?title=Page_"), key, F.lit("%20of_"), F.initcap("c_mktsegment"), F.lit("&amp;oldid="), key).alias("document_url"),
        F.concat(F.lit("<H1> About <i>no</i> "), key, F.lit(" </H1> <P> First "), key, F.lit(" </P> body <Ul> <Li> x </Li> </Ul> tail <Ul> y </Ul>")).alias("document_text"),
        F.when(F.col("c_custkey") % 2 == 0, "Own Title").otherwise("").alias("document_title"), F.lit("x").alias("document_html"),
    )


_URL_TITLE = "'Page ' || c_custkey || ' of ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"


@query(f"""
WITH u AS (SELECT c_custkey, {_URL_TITLE} AS t, 'About <i>no</i> ' || c_custkey AS h FROM customer),
o AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'Own Title' ELSE t END AS own FROM u)
SELECT c_custkey, 'nq' AS source, t AS document_url_title, h AS document_h1_title, own AS document_nq_title, CASE WHEN c_custkey % 10 = 0 THEN own ELSE h END AS nci_dedup_title FROM o
""")
def title_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wiki(spark, sf_dir)
    both = projections.add_titles(rows.where("c_custkey % 10 <> 0"), "nq", "train").unionByName(projections.add_titles(rows.where("c_custkey % 10 = 0"), "nq", "validation"))
    return both.select("c_custkey", "source", "document_url_title", "document_h1_title", "document_nq_title", "nci_dedup_title")


@query(f"""
WITH u AS (SELECT c_custkey, {_URL_TITLE} AS t, 'About no ' || c_custkey AS h, ' First ' || c_custkey || ' body x' AS b FROM customer)
SELECT c_custkey, 'simplified' AS style, '<H1> About <i>no</i> ' || c_custkey || ' </H1> <P> First ' || c_custkey || ' </P> body <Ul> <Li> x </Li> </Ul> tail <Ul> y </Ul>' AS document_text FROM u
UNION ALL SELECT c_custkey, 'simplenorm', h || ' First ' || c_custkey || ' body x tail y' FROM u
UNION ALL SELECT c_custkey, 'title-abstract-content', h || ' First ' || c_custkey || ' ' || 'body x' FROM u
UNION ALL SELECT c_custkey, 'ncinorm', CASE WHEN c_custkey % 2 = 0 THEN 'Own Title' ELSE t END || ' First ' || c_custkey || ' ' || 'body x' FROM u
""")
def question_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The styles of validation rows; markup columns go."""
    rows, out = _wiki(spark, sf_dir), None
    for style in ("simplified", "simplenorm", "title-abstract-content", "ncinorm"):
        part = projections.apply_style(rows, style, "validation", "simple")
        assert "document_html" not in part.columns
        part = part.select("c_custkey", F.col("document_normalization").alias("style"), "document_text")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_partkey, replace(p_name, ' ', '_') || ' ' || replace(p_type, ' ', '_') || ' ' || p_brand AS document_text FROM part")
def simple_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full layout as the simple one: a blank inside a token becomes an underscore."""
    parts = table(spark, sf_dir, "part")
    array = F.array(*[F.struct(F.lit(0).cast("bigint").alias("start_byte"), F.lit(1).cast("bigint").alias("end_byte"), F.lit(False).alias("html_token"), F.col(c).alias("token")) for c in ("p_name", "p_type", "p_brand")])
    full = parts.select("p_partkey", F.lit("q").alias("question_text"), F.lit("u").alias("document_url"), F.lit("h").alias("document_html"), array.alias("document_tokens"))
    if detect_layout(full.columns) != "full":
        raise ValueError("this is the full layout")
    return projections.simplify_questions(full).select("p_partkey", "document_text")


@query("""
SELECT CAST(p_partkey AS BIGINT) AS example_id, p_name AS question_text, 'u/' || p_partkey AS document_url, p_brand AS document_title, '0-2:true:' || p_brand || '|3-' || p_size || ':false:' || p_type AS tokens,
       p_size || '-' || (p_size + 1) || ':true' AS candidates, CASE p_partkey % 3 WHEN 0 THEN 'NO' WHEN 1 THEN 'YES' ELSE 'NONE' END AS answer FROM part
""")
def columnar_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of structs of lists as the full one."""
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey")
    big = lambda *x: F.array(*[F.lit(v).cast("bigint") if isinstance(v, int) else v for v in x])
    rows = table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"),
        F.struct(
            F.col("p_brand").alias("title"), F.concat(F.lit("u/"), key.cast("string")).alias("url"), F.lit("h").alias("html"),
            F.struct(F.array("p_brand", "p_type").alias("token"), F.array(F.lit(True), F.lit(False)).alias("is_html"), big(0, 3).alias("start_byte"), big(2, size).alias("end_byte")).alias("tokens"),
        ).alias("document"),
        F.struct(F.col("p_name").alias("text"), F.array("p_name").alias("tokens")).alias("question"),
        F.struct(big(size).alias("start_token"), big(size + 1).alias("end_token"), F.array(F.lit(True)).alias("top_level")).alias("long_answer_candidates"),
        F.struct(
            F.array(F.lit("13591449469826568799")).alias("id"), F.array(F.struct(size.alias("start_token"), size.alias("end_token"), size.alias("candidate_index"))).alias("long_answer"),
            F.array(F.struct(big(1).alias("start_token"), big(2).alias("end_token"))).alias("short_answers"), F.array((key % 3).cast("int")).alias("yes_no_answer"),
        ).alias("annotations"),
    )
    full = projections.columnar_questions(rows)
    shown = F.array_join(F.transform("document_tokens", lambda t: F.concat(t["start_byte"].cast("string"), F.lit("-"), t["end_byte"].cast("string"), F.lit(":"), t["html_token"].cast("string"), F.lit(":"), t["token"])), "|")
    one = F.col("long_answer_candidates")[0]
    candidates = F.concat(one["start_token"].cast("string"), F.lit("-"), one["end_token"].cast("string"), F.lit(":"), one["top_level"].cast("string"))
    return full.select("example_id", "question_text", "document_url", "document_title", shown.alias("tokens"), candidates.alias("candidates"), F.col("annotations")[0]["yes_no_answer"].alias("answer"))


@query("SELECT CAST(l_partkey AS VARCHAR) AS docid, count(*) AS n FROM lineitem GROUP BY l_partkey")
def only_query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.only_queries(tables.parts(spark, sf_dir)).groupBy("docid").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lang AS document_normalization FROM documents WHERE lang IS DISTINCT FROM 'en'")
def style_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.style_mismatches(table(spark, sf_dir, "documents").withColumnRenamed("lang", "document_normalization"), "en")


# --- scalars and keys


@query("""
WITH p AS (SELECT c_custkey, c_name AS a, c_mktsegment AS b, coalesce(list_min(list_filter(range(1, least(length(c_name), length(c_mktsegment)) + 1), lambda i: substr(c_name, i, 1) <> substr(c_mktsegment, i, 1))) - 1, least(length(c_name), length(c_mktsegment))) AS place FROM customer)
SELECT c_custkey, 'A: ' || substr(a, 1, CAST(place AS BIGINT) + 6) || chr(10) || 'B: ' || substr(b, 1, CAST(place AS BIGINT) + 6) || chr(10) || '   ' || repeat(' ', CAST(place AS BIGINT)) || '^' AS shown FROM p
""")
def difference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("at", text.first_difference("c_name", "c_mktsegment"))
    return rows.select("c_custkey", text.difference_window("c_name", "c_mktsegment", "at", 40, 6).alias("shown"))


@query("""
WITH f AS (SELECT embedding AS f FROM embeddings WHERE vec_id = 0)
SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: CAST(CAST(round((CAST(embedding[i] AS DOUBLE) + f[i]) / 2 * 10000) AS BIGINT) AS VARCHAR)), ',') AS mean FROM embeddings, f
""")
def vector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each vector and the first one, in ten-thousandths."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").select(F.col("embedding").alias("first"))
    mean = vectors.divide(vectors.add(F.col("embedding"), F.col("first")), F.lit(2))
    return rows.join(F.broadcast(first)).select("vec_id", F.array_join(F.transform(mean, lambda x: F.round(x * 10000).cast("bigint").cast("string")), ",").alias("mean"))


_TITLED = {
    "title": "lower(t)", "title-cased": "t", "h1": "lower(h)", "h1-cased": "h", "url": "lower(u)", "url-cased": "u", "nci-h1": "h", "ncititle": "t",
    "tokens-32": "substr(hex(encode(lower(substr(x, 1, 256)))), 1, 64)", "tokens-32-cased": "substr(hex(encode(substr(x, 1, 256))), 1, 64)", "pageid": "CAST(p AS VARCHAR)",
}


@query(
    "WITH k AS (SELECT c_custkey % 10 = 0 AS v, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' a' ELSE ' A' END || c_custkey % 40 AS t, CASE WHEN c_custkey % 3 = 0 THEN 'HEAD ' ELSE 'head ' END || c_custkey % 70 AS h, "
    "'<H1> ' || h || ' </H1> ' || c_name || repeat(' more words', 30) AS x, 'https://W.example/?title=' || replace(t, ' ', '_') AS u, c_custkey % 90 AS p FROM customer) "
    + " UNION ALL ".join(f"SELECT '{m}' AS method, count(DISTINCT CASE WHEN NOT v THEN {k} END) AS n_train, count(DISTINCT CASE WHEN v THEN {k} END) AS n_validation, count(DISTINCT {k}) AS n_union FROM k" for m, k in _TITLED.items())
)
def unique_counts_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different documents by the keys of titles, headings, URLs, tokens and page ids."""
    key = F.col("c_custkey")
    t = F.concat("c_mktsegment", F.when(key % 2 == 0, " a").otherwise(" A"), (key % 40).cast("string"))
    h = F.concat(F.when(key % 3 == 0, "HEAD ").otherwise("head "), (key % 70).cast("string"))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("<H1> "), h, F.lit(" </H1> "), F.col("c_name"), F.repeat(F.lit(" more words"), 30)).alias("document_text"),
        F.concat(F.lit("https://W.example/?title="), F.replace(t, F.lit(" "), F.lit("_"))).alias("document_url"), (key % 90).alias("pageid"), F.when(key % 10 == 0, "validation").otherwise("train").alias("split"),
    )
    return grouping.unique_counts(rows, {m: keys.key_for(m, rows.columns) for m in _TITLED})


@query("""
SELECT 'one token each' AS labels, count(*) > 0 AS is_atomic FROM customer
UNION ALL SELECT 'some of two', bool_and((c_custkey + 259) % 100 <> 0) FROM customer
UNION ALL SELECT 'unknown ones', bool_and((c_custkey + 259) % 7 <> 0) FROM customer
""")
def atomic_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 259).cast("int").alias("token_id"))
    labels = F.array(F.col("token_id"), F.lit(1), F.lit(-100))
    cases = {
        "one token each": (labels, rows), "some of two": (F.when(F.col("token_id") % 100 == 0, F.array(F.col("token_id"), F.lit(300), F.lit(1))).otherwise(labels), rows), "unknown ones": (labels, rows.where("token_id % 7 <> 0")),
    }
    out = None
    for name, (column, added) in cases.items():
        part = grouping.atomic_targets(rows.select(column.alias("labels")), added, 1).select(F.lit(name).alias("labels"), "is_atomic")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey + 1000 AS BIGINT) ELSE CAST('0x' || substr(md5({_URL_TITLE}), 1, 15) AS BIGINT) END AS pageid FROM customer")
def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids from a map of revisions that is read from JSON; a hash of the title stands where the map has none."""
    path = new_path(spark, "revisions")
    customers = table(spark, sf_dir, "customer")
    customers.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("oldid"), (F.col("c_custkey") + 1000).alias("pageid")).write.json(path)
    rows = _wiki(spark, sf_dir)
    title = text.url_title("document_url")
    found = joins.with_page_ids(rows, readers.read_revisions(spark, path), text.url_parameter("document_url", "oldid"), title)
    return found.select("c_custkey", "pageid")


@query("SELECT CAST(ceil(count(*) / 64.0) AS BIGINT) AS steps, CAST(floor(ceil(count(*) / 64.0) * 3 * 0.1) AS BIGINT) AS warmup, 'one-per-document' AS sampling FROM orders")
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an epoch and of the warm-up for the orders as samples, under checked options."""
    options = sampling.SamplingOptions(query_sampling="one-per-document")
    steps = sampling.steps_per_epoch(table(spark, sf_dir, "orders").count(), 16, 2, 2)
    return spark.createDataFrame([(steps, sampling.warmup_steps(steps, 3, ratio=0.1), options.query_sampling)], "steps long, warmup long, sampling string")


# --- scans and sinks


@query(f"WITH {_CUSTOMER_TEXTS} SELECT split, docid, CASE WHEN split = 'documents' THEN lower(substr(text, 1, 8)) ELSE text END AS text FROM c")
def package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus written as a package of gzipped JSON and read back, its documents cut and lower-cased."""
    path = new_path(spark, "package")
    corpus = tables.customers(spark, sf_dir).map(lambda _, df: df.withColumn("source_ids", F.array("docid")))
    sinks.write_package(corpus, path, {"text_style": "plain"}, single_file=False)
    back = projections.require_package(readers.read_package(spark, path, text_limit=8, lowercase=True))
    for name in back:
        projections.require_columns(name, back[name], ["docid", "kind", "text", "title", "source_ids"])
    return _all_splits(back, "docid", "text")


@query("SELECT 'documents' AS split, CAST(p_partkey AS VARCHAR) AS docid, p_name AS title FROM part UNION ALL SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'validation_queries' ELSE 'train_queries' END, CAST(o_custkey AS VARCHAR), o_orderpriority FROM orders")
def ranking_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ranking")
    table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("docid"), F.lit("u").alias("url"), F.col("p_name").alias("title"), F.col("p_type").alias("body")).write.json(f"{path}/data/documents.jsonl")
    orders = table(spark, sf_dir, "orders")
    queries = orders.select(F.lit("query").alias("kind"), F.col("o_orderkey").cast("string").alias("query_id"), F.col("o_orderpriority").alias("text"), F.col("o_custkey").cast("string").alias("docid"), "o_orderkey")
    queries.where("o_orderkey % 10 <> 0").drop("o_orderkey").write.json(f"{path}/data/train_queries.jsonl")
    queries.where("o_orderkey % 10 = 0").drop("o_orderkey").write.json(f"{path}/data/validation_queries.jsonl")
    corpus = readers.read_ranking(spark, path)
    shown = Corpus({DOCUMENTS: corpus[DOCUMENTS], **{s: corpus[s].withColumnRenamed("text", "title") for s in (TRAIN_QUERIES, VALIDATION_QUERIES)}})
    return _all_splits(shown, "docid", "title")


def _lines(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Lines of text, written and scanned."""
    path = new_path(spark, label)
    rows.select("value").write.text(path)
    return readers.read_lines(spark, path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS qid, o_orderpriority || chr(9) || 'x' AS query FROM orders WHERE o_orderkey % 5 <> 0")
def query_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an id and a query, cut at the first tab; lines without one are skipped."""
    key = F.col("o_orderkey")
    value = F.when(key % 5 == 0, key.cast("string")).otherwise(F.concat_ws("\t", key.cast("string"), F.col("o_orderpriority"), F.lit("x")))
    return readers.parse_query_lines(_lines(spark, table(spark, sf_dir, "orders").select(value.alias("value")), "queries"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_partkey AS VARCHAR) AS docid, CAST(l_linenumber AS INTEGER) AS relevance, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL")
def judgement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    fields = F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.lit("Q0 "), F.col("l_partkey").cast("string"))
    value = F.when(F.col("l_linenumber") == 3, fields).otherwise(F.concat_ws("\t", fields, F.col("l_linenumber").cast("string")))
    return readers.parse_judgement_lines(_lines(spark, lines.select(value.alias("value")), "judgements")).groupBy("qid", "docid", "relevance").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 'malformed' WHEN p_size <= 10 THEN 'inactive' WHEN p_partkey % 7 = 0 THEN 'empty' ELSE 'written' END AS state FROM part)
SELECT 'row' AS what, CAST(p_partkey AS VARCHAR) AS docid, p_name AS title, p_type || chr(9) || p_brand AS body FROM d WHERE state = 'written'
UNION ALL SELECT 'counts', NULL, count(*) FILTER (state = 'written') || '/' || count(*) FILTER (state = 'malformed') || '/' || count(*) FILTER (state = 'inactive') || '/' || count(*) FILTER (state = 'empty'),
  CAST(1 + count(*) FILTER (state = 'malformed' AND p_size > 10) AS VARCHAR) FROM d
""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of four fields, filtered by the active docids, and the accounting of what was left out."""
    key, parts = F.col("p_partkey"), table(spark, sf_dir, "part")
    body = F.when(key % 7 == 0, " ").otherwise(F.concat_ws("\t", "p_type", "p_brand"))
    value = F.when(key % 10 == 0, key.cast("string")).otherwise(F.concat_ws("\t", key.cast("string"), F.lit("u"), F.col("p_name"), body))
    active = parts.where("p_size > 10").select(key.cast("string").alias("docid")).unionByName(spark.createDataFrame([("none",)], "docid string"))
    found, counts = readers.active_documents(readers.parse_document_lines(_lines(spark, parts.select(value.alias("value")), "documents")), active)
    shown = F.concat_ws("/", *[F.col(c).cast("string") for c in ("written", "malformed", "inactive", "empty")])
    rows = found.select(F.lit("row").alias("what"), "docid", "title", "body")
    return rows.unionByName(counts.select(F.lit("counts").alias("what"), F.lit(None).cast("string").alias("docid"), shown.alias("title"), F.col("missing").cast("string").alias("body")))


@query("SELECT c_custkey, 1 AS made FROM customer")
def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that is made once and read twice."""
    path, made = sinks.stage_folder(new_path(spark, "stages"), 1), []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, sf_dir, "customer").select("c_custkey")

    sinks.cached_stage(spark, path, make, ("c_custkey",))
    again = sinks.cached_stage(spark, path, make, ("c_custkey",))
    return again.select("c_custkey", F.lit(len(made)).alias("made"))


@query("SELECT 'titles' AS split, lower(c_name) AS text FROM customer UNION ALL SELECT 'documents', concat_ws(' ', c_name, c_mktsegment) FROM customer")
def augmentation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An augmentation under the digest of its inputs; the second call reads what the first one wrote."""
    corpus = Corpus({DOCUMENTS: tables.customers(spark, sf_dir)[DOCUMENTS]})
    root = new_path(spark, "augmentations")
    key = sinks.cache_key("1", "titles", {"lowercase": True}, 42, "default", {DOCUMENTS: corpus[DOCUMENTS]})
    sinks.cached_augmentation(root, key, corpus, lambda c: c.merge(extra={"titles": projections.titles_split(c[DOCUMENTS])}))

    def never(_: Corpus) -> Corpus:
        raise RuntimeError("the augmentation is there already")

    return _all_splits(sinks.cached_augmentation(root, key, corpus, never), "text")


@query(f"""
WITH {_CUSTOMER_TEXTS}, t AS (SELECT CASE WHEN split = 'validation_queries' THEN 'validation' ELSE 'train' END AS split, docid FROM c)
SELECT t.split, t.docid, count(*) AS n, (SELECT count(*) FROM t s WHERE s.split = t.split) AS total FROM t GROUP BY ALL
""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows exported as JSON with their metadata, and read back."""
    path = new_path(spark, "export")
    corpus = tokens.multitask(tokens.tokenise(tables.customers(spark, sf_dir)))
    corpus = corpus.map(lambda _, df: df.select("kind", "docid", "input_ids", "labels"))
    sinks.export(corpus, path, summary={"seed": 42})
    meta = readers.read_run_metadata(spark, f"{path}/default")
    back = readers.read_export(spark, f"{path}/default")
    counts = {s: meta["splits"][s]["rows"] for s in back}
    total = F.when(F.col("split") == "train", counts["train"]).otherwise(counts["validation"]).cast("bigint")
    return _all_splits(back, "docid").groupBy("split", "docid").agg(F.count("*").alias("n")).withColumn("total", total)


@query("SELECT 'parquet' AS format, c_custkey, c_name FROM customer UNION ALL SELECT 'hf_disk', c_custkey, c_name FROM customer UNION ALL SELECT 'refused', NULL, 'csv'")
def split_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits in the column formats, and the refusal of an unknown one."""
    folder, rows = new_path(spark, "formats"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    out = None
    for fmt in ("parquet", "hf_disk"):
        part = spark.read.schema(rows.schema).parquet(sinks.write_split(rows, folder, "documents", fmt)).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    try:
        sinks.write_split(rows, folder, "documents", "csv")
    except ValueError:
        return out.unionByName(spark.createDataFrame([(None, "csv", "refused")], out.select("c_custkey", "c_name", "format").schema).select(*out.columns))
    raise ValueError("csv is no export format")


@query("SELECT 'first' AS what, c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30) UNION ALL SELECT 'seventh', c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 6)")
def named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of a named dataset and one of its rows."""
    first = readers.read_named(spark, f"{sf_dir}/customer.parquet", limit=30, order="c_custkey").select(F.lit("first").alias("what"), "c_custkey")
    return first.unionByName(readers.nth_row(table(spark, sf_dir, "customer"), 6, "c_custkey").select(F.lit("seventh").alias("what"), "c_custkey"))


@query("""
SELECT '<doc_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '>' AS token, CAST(259 + row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS token_id, CAST(c_custkey AS DOUBLE) + 1.5 AS total FROM customer
""")
def token_init_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tokens and their initial vectors, read from JSON and matched."""
    path, customers = new_path(spark, "tokens"), table(spark, sf_dir, "customer")
    token = F.concat(F.lit("<doc_"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(">"))
    listed = customers.select(F.lit(259).cast("bigint").alias("base_vocab_size"), token.alias("token")).groupBy("base_vocab_size").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    listed.write.json(f"{path}/tokens.jsonl")
    customers.select(token.alias("token"), F.array(F.col("c_custkey").cast("double"), F.lit(1.5)).alias("payload")).write.json(f"{path}/init.jsonl")
    vocabulary = joins.added_token_ids(readers.read_token_table(spark, f"{path}/tokens.jsonl"))
    if joins.duplicate_tokens(vocabulary).take(1):
        raise ValueError("a token stands twice")
    found = joins.resolve_token_init(readers.read_token_init(spark, f"{path}/init.jsonl"), vocabulary, 2)
    return found.select("token", "token_id", F.aggregate("payload", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("""
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'validation_queries' ELSE 'train_queries' END AS job, 'NaN' AS loss, count(*) AS n, count(DISTINCT o_custkey) AS n_docids,
       round(sum(1.0 / (1 + o_orderkey % 7)) / count(*), 6) AS mrr FROM orders GROUP BY 1
""")
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the orders' splits appended to a history, read back; a metrics file says the same of each."""
    path = new_path(spark, "metrics")
    split = F.when(F.col("o_orderkey") % 10 == 0, VALIDATION_QUERIES).otherwise(TRAIN_QUERIES)
    found = table(spark, sf_dir, "orders").groupBy(split.alias("job")).agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_docids"), F.round(F.avg(1.0 / (1 + F.col("o_orderkey") % 7)), 6).alias("mrr")
    )
    for row in found.collect():  # one row for each split
        values = {"loss": float("nan"), "n": row.n, "n_docids": row.n_docids, "mrr": row.mrr}
        sinks.append_metrics(spark, values, path, row.job)
        written = sinks.write_metrics(spark, values, f"{path}/{row.job}.json")
        if json.loads(written) != json.loads(readers.read_text(spark, f"{path}/{row.job}.json")):
            raise ValueError("the metrics file differs")
    return spark.read.schema("job string, loss string, n long, n_docids long, mrr double").json(f"{path}/metrics_history.jsonl")


@query("SELECT 'extra' AS split, count(*) AS n FROM orders UNION ALL SELECT 'documents', count(*) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'refused: documents', 0")
def merged_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits replaced and added in a corpus, and the refusal of an output that would hide a split."""
    corpus = Corpus({DOCUMENTS: tables.customers(spark, sf_dir)[DOCUMENTS]})
    merged = corpus.merge({DOCUMENTS: corpus[DOCUMENTS].where(F.col(ORD) % 2 == 0)}, {"extra": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ORD))})
    out = _all_splits(merged, ORD).groupBy("split").agg(F.count("*").alias("n"))
    try:
        corpus.check_output(DOCUMENTS, ("extra",))
    except ValueError:
        return out.unionByName(spark.createDataFrame([("refused: documents", 0)], out.schema))
    raise ValueError("the output hides a split")


# --- pages rendered as text


def _rendered(rows: DataFrame, key: str, html: Column, **options) -> DataFrame:
    """tag, title and text of pages that are made from a table's columns.

    A page takes far more work than reading its row: rows are dealt out, however few files they came from.
    """
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.select(key, html.alias("html")).select(key, html_tree.normalise_pages("html", **options).alias("n")).select(key, "n.tag", "n.title", "n.text")


@query("""
SELECT c_custkey, 'htmlnorm-v1-infobox-none' AS tag, 'Customer ' || c_custkey AS title,
       'Customer ' || c_custkey || chr(10) || 'The ' || c_name || ' fi ' || chr(10) || chr(10) || 'Segment: ' || lower(c_mktsegment) || chr(10) || chr(10) || 'Life' || chr(10) || 'Born & bred ' || c_nationkey AS text FROM customer
""")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by headings: the intro's paragraphs stand before its tables, marks, metadata tables and unwanted sections go."""
    key = F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit("<html><head><title>no</title></head><body><h1>Customer "), key, F.lit("</h1>loose<table class='x metadata'><tr><td>m</td></tr></table><table><tr><th>Segment:</th><td>"), F.lower("c_mktsegment"),
        F.lit("</td></tr></table><p>The <b>"), F.col("c_name"), F.lit("</b> ﬁ [edit]</p><h2>Life</h2><p>Born &amp; bred "), F.col("c_nationkey").cast("string"),
        F.lit("</p><h2>See also</h2><ul><li>gone</li></ul><h2>References</h2><p>gone</p><h2>Empty</h2></body></html>"),
    )
    return _rendered(table(spark, sf_dir, "customer"), "c_custkey", html)


_SECTION = "'T' || chr(10) || 'a' || chr(10) || chr(10) || 'L' || chr(10) || "


def _section(*inner: Column) -> Column:
    return F.concat(F.lit("<h1>T</h1><p>a</p><h2>L</h2>"), *inner)


@query(f"""
SELECT p_partkey, 'htmlnorm-v1-no_infobox-none' AS tag, 'T' AS title, {_SECTION}chr(10) || p_size || '. ' || p_name || chr(10) || '  - ' || p_brand || chr(10) || (p_size + 1) || '. end'
       || chr(10) || chr(10) || p_type || ': first' || chr(10) || 'also: first' AS text FROM part
""")
def html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lists from their start, nested ones indented, and definition lists."""
    size = F.col("p_size").cast("string")
    html = _section(F.lit("<ol start='"), size, F.lit("'><li>"), F.col("p_name"), F.lit("<ul><li>"), F.col("p_brand"), F.lit("</li></ul></li><li>end</li></ol><dl><dt>"), F.col("p_type"), F.lit("</dt><dt>also</dt><dd>first</dd></dl>"))
    return _rendered(table(spark, sf_dir, "part"), "p_partkey", html, remove_infobox=True)


_LONG = "one two three four five six seven eight"


@query(f"""
SELECT p_partkey, 'htmlnorm-v1-infobox-none' AS tag, 'T' AS title, {_SECTION}chr(10) || CASE p_partkey % 4
  WHEN 0 THEN 'Brand: ' || p_brand || chr(10) || 'Size: ' || p_size || ' ; ' || p_type
  WHEN 1 THEN 'N: {_LONG} ' || p_brand || ' ; M: ' || p_size || ' ; O: z' || chr(10) || 'N: {_LONG} x ; M: y ; O: z'
  WHEN 2 THEN '{_LONG} ; ' || p_size || ' ; ' || p_brand || chr(10) || '{_LONG} ; {_LONG} p ; q ; q'
  ELSE '{_LONG} ' || p_name || chr(10) || '{_LONG} ' || p_type || chr(10) || '{_LONG} nine' END AS text FROM part
""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pairs, of records under a header, of plain cells with spans, and of one column."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pairs = F.concat(F.lit("<tr><th>Brand:</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td></tr><tr><th>Size</th><td>"), size, F.lit("</td><td>"), F.col("p_type"), F.lit("</td></tr>"))
    records = F.concat(F.lit(f"<tr><th>N</th><th>M</th><th>O</th></tr><tr><td>{_LONG} "), F.col("p_brand"), F.lit("</td><td>"), size, F.lit(f"</td><td>z</td></tr><tr><td>{_LONG} x</td><td>y</td><td>z</td></tr>"))
    matrix = F.concat(F.lit(f"<tr><td rowspan='2'>{_LONG}</td><td>"), size, F.lit("</td><td>"), F.col("p_brand"), F.lit(f"</td></tr><tr><td>{_LONG} p</td><td colspan='2'>q</td></tr>"))
    column = F.concat(F.lit(f"<tr><td>{_LONG} "), F.col("p_name"), F.lit(f"</td></tr><tr><td>{_LONG} "), F.col("p_type"), F.lit(f"</td></tr><tr><td>{_LONG} nine</td></tr>"))
    body = F.when(key % 4 == 0, pairs).when(key % 4 == 1, records).when(key % 4 == 2, matrix).otherwise(column)
    return _rendered(table(spark, sf_dir, "part"), "p_partkey", _section(F.lit("<table>"), body, F.lit("</table>")))


@query("""
SELECT c_custkey, 'htmlnorm-v1-infobox-bytes' AS tag, 'Name ' || c_custkey AS title, 'Name ' || c_custkey || chr(10) || c_name || ' (known) is here' AS text FROM customer
""")
def html_intro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intro's parentheses stay if the tokenizer knows all of their words, and go otherwise."""
    key = F.col("c_custkey").cast("string")
    html = F.concat(F.lit("<h1>Name "), key, F.lit("</h1><p>"), F.col("c_name"), F.lit(" (known) (nɛɪm) is here</p>"))
    return _rendered(table(spark, sf_dir, "customer"), "c_custkey", html, tokenizer=_Known())


class _Known:
    """Words of ASCII letters are known."""

    name, eos_id, unk_id, vocab_size = "bytes", BYTES.eos_id, BYTES.unk_id, BYTES.vocab_size

    def encode(self, value: str) -> list[int]:
        return [self.unk_id if not w.isascii() else 3 for w in value.split()]

    def decode(self, ids: list[int]) -> str:
        return ""
