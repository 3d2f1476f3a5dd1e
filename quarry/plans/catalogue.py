"""The registered queries, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES
from quarry.functions import keys, ordinals, styles, text, vectors
from quarry.functions.ordinals import ORD
from quarry.operators import grouping, html_tree, identifiers, joins, metrics, projections, sampling, semantic, tokens
from quarry.plans import tables
from quarry.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- grouping of documents

_GROUPS = """
WITH k AS (SELECT doc_id, {key} AS k FROM documents),
g AS (SELECT k, min({order}) AS first, count(*) AS n FROM k GROUP BY k),
d AS (SELECT k, CAST(row_number() OVER (ORDER BY first) - 1 AS VARCHAR) AS docid, n FROM g),
s AS (SELECT k, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY {order}) AS source_ids FROM k GROUP BY k)
SELECT d.docid, d.n AS n_examples, s.source_ids FROM d JOIN s USING (k)
"""


def _grouped(spark: SparkSession, sf_dir: str, method: str, validation_first: bool = False) -> DataFrame:
    rows = tables.examples(spark, sf_dir)
    order = grouping.split_order(F.col("split"), F.col(ORD)) if validation_first else F.col(ORD)
    documents, _ = grouping.group_by_key(rows, keys.key_for(method, rows.columns), order, F.col("example_id"), ["question_text"], sources=True)
    return documents.select("docid", "n_examples", F.array_join("source_ids", ",").alias("source_ids"))


@query(_GROUPS.format(key="md5(lower(substr(text, 1, 4000)))", order="doc_id"))
def dedup_text4k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "text4k")


@query(_GROUPS.format(key="md5(substr(text, 1, 4000))", order="doc_id"))
def dedup_text4k_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "text4k-cased")


@query(_GROUPS.format(key="md5(lower(text))", order="doc_id"))
def dedup_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "full-text")


@query(_GROUPS.format(key="md5(lower(substr(text, 1, 4000)))", order="(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END, doc_id)").replace("min((", "min(row(").replace("ORDER BY (CASE", "ORDER BY row(CASE"))
def dedup_validation_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "text4k", validation_first=True)


@query("""
WITH k AS (SELECT doc_id, md5(lower(substr(text, 1, 4000))) AS k FROM documents),
d AS (SELECT k, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS VARCHAR) AS docid FROM k GROUP BY k)
SELECT k.doc_id AS example_id, d.docid FROM k JOIN d USING (k)
""")
def dedup_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example as a query of its group's document."""
    rows = tables.examples(spark, sf_dir)
    _, queries = grouping.group_by_key(rows, keys.key_for("text4k", rows.columns), F.col(ORD), F.col("example_id"), ["question_text"])
    return queries.select("example_id", "docid")


@query("""
SELECT doc_id AS example_id, CAST(row_number() OVER (ORDER BY CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END, doc_id) - 1 AS VARCHAR) AS docid FROM documents
""")
def dedup_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.examples(spark, sf_dir)
    one, two = grouping.number_without_grouping(rows.where("split = 'train'"), rows.where("split = 'validation'"), [ORD])
    return one.unionByName(two).select("example_id", "docid")


@query("""
WITH p AS (SELECT page_id, md5(lower(regexp_replace(url, '[?#].*$', ''))) AS k FROM pages),
d AS (SELECT k, CAST(row_number() OVER (ORDER BY min(page_id)) - 1 AS VARCHAR) AS docid, count(*) AS n FROM p GROUP BY k)
SELECT docid, n AS n_examples FROM d
""")
def dedup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("document_url", F.regexp_replace("url", "[?#].*$", ""))
    documents, _ = grouping.group_by_key(rows, keys.key_for("url", rows.columns), F.col("page_id"), F.col("page_id"), ["url"])
    return documents.select("docid", "n_examples")


_METHODS = {"full-text": "md5(lower(text))", "full-text-cased": "md5(text)", "text4k": "md5(lower(substr(text, 1, 4000)))", "text4k-cased": "md5(substr(text, 1, 4000))"}


@query(" UNION ALL ".join(
    f"SELECT '{m}' AS method, count(DISTINCT CASE WHEN doc_id % 10 <> 0 THEN {k} END) AS n_train, count(DISTINCT CASE WHEN doc_id % 10 = 0 THEN {k} END) AS n_validation, count(DISTINCT {k}) AS n_union FROM documents"
    for m, k in _METHODS.items()
))
def unique_counts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.examples(spark, sf_dir)
    return grouping.unique_counts(rows, {m: keys.key_for(m, rows.columns) for m in _METHODS})


@query("""
SELECT lang, source, count(*) AS n_texts, min(n) AS shortest, max(n) AS longest FROM (SELECT DISTINCT lang, source, md5(text) AS m, length(text) AS n FROM documents)
GROUP BY ALL HAVING count(*) > 1 ORDER BY n_texts DESC, lang, source LIMIT 20
""")
def keys_with_many_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.keys_with_many_texts(table(spark, sf_dir, "documents"), ["lang", "source"], "text", 20)


@query("""
WITH f AS (SELECT lang, source, text, min(doc_id) AS o, length(text) AS n FROM documents GROUP BY ALL),
a AS (SELECT lang, source, text, row_number() OVER (PARTITION BY lang, source ORDER BY n, o) AS r FROM f),
b AS (SELECT lang, source, text, row_number() OVER (PARTITION BY lang, source ORDER BY n DESC, o) AS r FROM f)
SELECT a.lang, a.source, md5(a.text) AS text_a, md5(b.text) AS text_b FROM a JOIN b USING (lang, source) WHERE a.r = 1 AND b.r = 1
""")
def extreme_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouping.extreme_texts(table(spark, sf_dir, "documents"), ["lang", "source"], "text", "doc_id")
    return out.select("lang", "source", F.md5("text_a").alias("text_a"), F.md5("text_b").alias("text_b"))


@query()
def first_differences_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of neighbouring documents, whole; its SQL would be too slow. difference_windows has SQL for the same operator."""
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("x")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("y")), "doc_id")
    return pairs.select("doc_id", text.first_difference("x", "y").alias("first_difference"))


@query("SELECT 'all' AS split_set, (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) AS train_pairs, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS validation_pairs")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.corpus_stats({"all": tables.customers(spark, sf_dir)})


# --- text and layout

_STRIP = r"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_STRIP.format(x='html')}) AS text_md5, length({_STRIP.format(x='html')}) AS n FROM pages")
def style_simplenorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("document_text", F.col("html"))
    styled = pages.select("page_id", styles.style_column("simplenorm").alias("t"))
    return styled.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n"))


@query(r"""
WITH p AS (SELECT page_id, html, strpos(html, '<p>') AS a FROM pages),
q AS (SELECT *, CASE WHEN a > 0 THEN strpos(substr(html, a + 3), '</p>') ELSE 0 END AS b, len(string_split(html, '</ul>')) - 1 AS n FROM p),
r AS (SELECT *, CASE WHEN n = 0 THEN length(html) ELSE length(array_to_string(list_slice(string_split(html, '</ul>'), 1, greatest(n - 1, 1)), '</ul>')) END AS stop, CASE WHEN b > 0 THEN a + 2 + b + 4 END AS begin FROM q)
SELECT page_id, md5(coalesce(CASE WHEN b > 0 THEN substr(html, a + 3, b - 1) END, '')) AS abstract,
       md5(coalesce(CASE WHEN stop > begin - 1 THEN substr(html, begin, CAST(stop - begin + 1 AS BIGINT)) END, '')) AS content
FROM r
""")
def style_abstract_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rest = text.content_after_abstract("html", ("<p>", "</p>"), "</ul>")
    return pages.select("page_id", F.md5(text.between("html", "<p>", "</p>")).alias("abstract"), F.md5(rest).alias("content"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]utm_source=([^&#]+)', 1), '') AS utm_source, nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]+)', 1), '') AS ref FROM pages")
def url_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[text.url_parameter("url", p).alias(p) for p in ("utm_source", "page", "ref")])


@query(r"SELECT docid, text FROM (SELECT CAST(page_id AS VARCHAR) AS docid, lower(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\s+', ' ', 'g'))) AS text FROM pages) WHERE text <> ''")
def titles_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("docid"), text.between("html", "<title>", "</title>").alias("title"))
    return projections.titles_split(pages)


@query("""
SELECT doc_id AS example_id, md5(lower(substr(text, 1, 4000))) AS text_md5, length(lower(substr(text, 1, 4000))) AS n_chars, '' AS title, CAST(doc_id AS VARCHAR) AS source_id,
       split_part(text, chr(10), 1) AS question FROM documents
""")
def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the text limit of the questions plugin."""
    rows = tables.examples(spark, sf_dir)
    document = rows.select("example_id", "question_text", *projections.question_document("document_text", "document_url", "example_id", 4000))
    return document.select("example_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"), "title", F.col("source_ids")[0].alias("source_id"), F.col("question_text").alias("question"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS docid, concat_ws(' ', nullif(lower(trim(p_name)), ''), nullif(lower(trim(substr(p_type, 1, 8))), '')) AS text, lower(trim(p_name)) AS title FROM part")
def ranking_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").cast("string").alias("docid"), *projections.ranking_document("p_name", "p_type", "title-content", 8))


@query("SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 4 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 4, '0') END AS padded, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM customer")
def scalar_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.zero_fill("c_custkey", 4).alias("padded"), text.safe_name("c_name").alias("safe"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS docid, 'document' AS kind FROM customer UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'query' FROM orders WHERE o_orderkey % 10 <> 0")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = projections.drop_columns(tables.customers(spark, sf_dir), ["text", "title", ORD], [DOCUMENTS, TRAIN_QUERIES])
    return corpus[DOCUMENTS].unionByName(corpus[TRAIN_QUERIES])


# --- joins


@query("""
WITH m AS (SELECT c_custkey, '<doc_' || lpad(CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR), CAST(length(CAST((SELECT count(*) FROM customer) - 1 AS VARCHAR)) AS INTEGER), '0') || '>' AS docid FROM customer)
SELECT o_orderkey, docid FROM orders JOIN m ON o_custkey = c_custkey
""")
def docid_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = tables.customers(spark, sf_dir)
    mapped = joins.assign_identifiers(corpus, identifiers.atomic_ids(corpus[DOCUMENTS]))
    return mapped[TRAIN_QUERIES].unionByName(mapped[VALIDATION_QUERIES]).select(F.col(ORD).alias("o_orderkey"), "docid")


@query("SELECT CAST(c_custkey AS VARCHAR) AS docid, 'document' AS kind, concat_ws(' ', c_name, c_mktsegment) AS text FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def validation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.validation_index(tables.customers(spark, sf_dir))


@query("""
WITH t AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0 ORDER BY o_orderkey LIMIT 500), v AS (SELECT * FROM orders WHERE o_orderkey % 10 = 0 ORDER BY o_orderkey LIMIT 500), q AS (SELECT * FROM t UNION ALL SELECT * FROM v)
SELECT 'query' AS kind, o_custkey AS docid, o_orderkey AS ord FROM q UNION ALL SELECT 'document', c_custkey, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM q)
""")
def limited_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = joins.limit_corpus(tables.customers(spark, sf_dir), 500)
    rows = [corpus[s].select("kind", F.col("docid").cast("bigint").alias("docid"), F.col(ORD).alias("ord")) for s in corpus]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'validation_queries' ELSE 'train_queries' END AS split, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) GROUP BY 1")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = tables.customers(spark, sf_dir)
    holed = corpus.replace(**{DOCUMENTS: corpus[DOCUMENTS].where(F.col(ORD) % 7 != 0)})
    return joins.dangling_queries(holed).groupBy("split").agg(F.count("*").alias("n"))


_PAIRS = "SELECT DISTINCT l_orderkey AS qid, l_partkey AS docid FROM lineitem WHERE l_returnflag <> 'R'"


@query(f"WITH p AS ({_PAIRS}) SELECT 'query' AS kind, p.qid AS query_id, o_orderpriority AS text, p.docid FROM p JOIN part ON p_partkey = docid AND p_size > 10 JOIN orders ON o_orderkey = qid")
def qrels_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("docid"))
    queries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("query"))
    return joins.query_rows(joins.judged_pairs(tables.judgements(spark, sf_dir), documents), queries)


@query(f"""
WITH p AS ({_PAIRS}), k AS (SELECT qid, count(*) AS n, count(p_partkey) AS kept FROM p LEFT JOIN part ON p_partkey = docid AND p_size > 10 GROUP BY qid)
SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS positive_rows, CAST(sum(n) AS BIGINT) AS pairs,
       CAST(sum(n - kept) AS BIGINT) AS removed_pairs, count(*) FILTER (kept = 0) AS emptied_queries FROM k
""")
def qrels_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("docid"))
    return joins.judgement_stats(tables.judgements(spark, sf_dir), documents)


@query("SELECT l_orderkey AS qid, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS docids FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1")
def qrels_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.judged_documents(tables.judgements(spark, sf_dir)).select("qid", F.array_join("docids", ",").alias("docids"))


# --- sampling

_SHUF = "md5('{seed}|{purpose}|' || CAST({key} AS VARCHAR))"


@query(f"""
WITH pool AS (SELECT o_orderkey AS k, o_custkey AS d, {_SHUF.format(seed=SEED, purpose='select', key='o_orderkey')} AS s FROM orders),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY s, k) AS r FROM pool) WHERE r = 1 ORDER BY s, k LIMIT 200),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY s, k) AS r FROM pool WHERE d NOT IN (SELECT d FROM v)) WHERE r = 1 ORDER BY s, k LIMIT 400)
SELECT 'validation_queries' AS split, k AS ord FROM v UNION ALL SELECT 'train_queries', k FROM t
UNION ALL SELECT 'documents', c_custkey FROM customer WHERE c_custkey IN (SELECT d FROM v UNION ALL SELECT d FROM t)
""")
def split_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.split_set(tables.customers(spark, sf_dir), sampling.SplitSpec("600", 400, 200, True), SEED, ORD)
    rows = [out[s].select(F.lit(s).alias("split"), F.col(ORD).alias("ord")) for s in out]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_SHUF.format(seed=SEED, purpose='shuffle', key='c_custkey')}, c_custkey) - 1 AS place FROM customer")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.shuffled(table(spark, sf_dir, "customer").select("c_custkey"), SEED, "c_custkey")
    return ordinals.with_dense_order(rows, ["_shuffle", "c_custkey"], "place").select("c_custkey", "place")


_LINES = """
r AS (SELECT CAST(p_partkey AS VARCHAR) AS docid, 'document' AS kind, 'd' || CAST(p_partkey AS VARCHAR) AS key FROM part UNION ALL
      SELECT CAST(l_partkey AS VARCHAR), 'query', concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) FROM lineitem)
"""


@query(f"""
WITH {_LINES}, q AS (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY md5('{SEED}|per-document|' || docid || '|' || key), key) - 1 AS i, count(*) OVER (PARTITION BY docid) AS n FROM r WHERE kind = 'query')
SELECT docid, kind, key FROM r WHERE kind = 'document' UNION ALL SELECT docid, kind, key FROM q WHERE i = 3 % n
""")
def one_query_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.one_query_per_document(tables.parts(spark, sf_dir), 3, SEED, "key").drop("_shuffle")


@query(f"""
WITH {_LINES}, c AS (SELECT docid, count(*) AS n FROM r WHERE kind = 'query' GROUP BY docid),
e AS (SELECT r.docid, kind, key, unnest(range(1, coalesce(n, 1) + 1)) AS copy FROM r LEFT JOIN c USING (docid) WHERE kind = 'document' UNION ALL SELECT docid, kind, key, 1 FROM r WHERE kind = 'query'),
p AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED + sampling.EPOCH_STEP}|epoch|' || key || '|' || CAST(copy AS VARCHAR)), key, copy) - 1 AS pos FROM e)
SELECT docid, kind, key, copy FROM p WHERE pos % 4 = 1
""")
def document_repeat_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.repeated_documents(tables.parts(spark, sf_dir), "query", 0, SEED, "key")
    return sampling.shard(rows, 1, 4, ["key", "_copy"]).select("docid", "kind", "key", F.col("_copy").alias("copy"))


@query(f"WITH {_LINES}, c AS (SELECT docid, count(*) FILTER (kind = 'document') AS d, count(*) FILTER (kind = 'query') AS q FROM r GROUP BY docid) SELECT CAST(sum(d * greatest(1, q)) AS BIGINT) + (SELECT count(*) FROM lineitem) AS n_samples FROM c")
def virtual_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.virtual_epoch(tables.parts(spark, sf_dir), "query")


@query("SELECT (SELECT count(*) FROM part) AS n_documents, count(*) AS n_queries, count(DISTINCT l_partkey) AS n_query_docids, (SELECT count(*) FROM part) + count(DISTINCT l_partkey) AS n_samples FROM lineitem")
def sampling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.sampling_summary(tables.parts(spark, sf_dir))


@query("SELECT CAST(l_partkey AS VARCHAR) AS docid, 1 AS n_documents, count(*) AS n_queries FROM lineitem GROUP BY l_partkey UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 0 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def queries_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.queries_per_document(tables.parts(spark, sf_dir)).select("docid", F.col("n_documents").cast("int").alias("n_documents"), "n_queries")


# --- layouts and tokens


@query("""
WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS docid, 'document' AS kind FROM customer)
SELECT 'train' AS split, docid, kind, count(*) AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM d UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'query' FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY ALL
UNION ALL SELECT 'validation', CAST(o_custkey AS VARCHAR), 'query', count(*) FROM orders WHERE o_orderkey % 10 = 0 GROUP BY ALL
""")
def multitask_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.multitask(tables.customers(spark, sf_dir), multiplier=2)
    rows = [out[s].groupBy(F.lit(s).alias("split"), "docid", "kind").agg(F.count("*").alias("n")) for s in out]
    return rows[0].unionByName(rows[1])


_IDS = "list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: CAST('0x' || h AS INTEGER) + 3)"


@query(f"SELECT doc_id, array_to_string(list_append(list_slice({_IDS.format(x='text')}, 1, 32), 1), ',') AS ids FROM documents")
def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = tokens.text_tokens(F.col("text"), F.lit("document"), document_max=32)
    return docs.select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query(f"SELECT doc_id, array_to_string(list_append(list_concat({_IDS.format(x=chr(39) + 'index:' + chr(39))}, list_slice({_IDS.format(x='text')}, 1, 32)), 1), ',') AS ids FROM documents")
def task_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.text_tokens(F.col("text"), F.lit("document"), document_max=32)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens.add_task_prefix(ids, F.lit("document")).cast("array<string>"), ",").alias("ids"))


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 + 259 AS INTEGER) AS label, CAST(2 AS INTEGER) AS n, '<doc_' || lpad(CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR), CAST(length(CAST((SELECT count(*) FROM customer) - 1 AS VARCHAR)) AS INTEGER), '0') || '>' AS docid FROM customer")
def added_token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = identifiers.atomic_ids(tables.customers(spark, sf_dir)[DOCUMENTS])
    added = joins.added_token_ids(identifiers.token_table(mapping, 259))
    rows = tokens.docid_tokens(mapping.select(F.col("new_docid").alias("docid")), added=added)
    return rows.select("docid", F.col("docid_tokens")[0].alias("label"), F.size("docid_tokens").alias("n"))


@query("SELECT doc_id, CAST(least(octet_length(encode(text)), 20) + 1 AS INTEGER) AS n FROM documents")
def query_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.text_tokens(F.col("text"), F.lit("query"), query_max=100_000_000)
    cut = projections.truncate_query_ids(F.col("ids"), None, 20, 1)
    return table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", F.size(cut).alias("n"))


@query("SELECT max(octet_length(encode(text))) AS max_new_tokens FROM documents")
def longest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.functions.tokenizers import encode_column

    rows = table(spark, sf_dir, "documents").select(encode_column(F.col("text")).alias("labels"))
    return grouping.longest_label([rows])


# --- identifiers


@query("SELECT CAST(doc_id AS VARCHAR) AS old_docid, '<doc_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), CAST(length(CAST((SELECT count(*) FROM documents) - 1 AS VARCHAR)) AS INTEGER), '0') || '>' AS new_docid FROM documents")
def atomic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.atomic_ids(_documents(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS old_docid, CAST(doc_id AS VARCHAR) AS new_docid FROM documents")
def identity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.identity_ids(_documents(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), F.col("doc_id").alias(ORD))


_ALPHABET = identifiers.ALPHABETS["base64_urlsafe"]
_HASH = "CAST('0x' || substr(sha256(encode(CAST(doc_id AS VARCHAR)) || unhex('0000000000000000')), 1, 16) AS UBIGINT)"


@query("SELECT CAST(doc_id AS VARCHAR) AS old_docid, " + " || ".join(f"substr('{_ALPHABET}', CAST(({_HASH} >> {6 * k}) & 63 AS BIGINT) + 1, 1)" for k in range(6)) + " AS new_docid FROM documents")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six digits of base 64. The SQL knows no second salt: it gives documents 125203 and 211202 one code, this the later one its next."""
    return identifiers.hash_ids(_documents(spark, sf_dir), length=6)


_UNIQUE = "SELECT count(*) AS n, count(*) AS n_distinct, {more} FROM documents"


@query(_UNIQUE.format(more="true AS in_range, CAST(6 AS INTEGER) AS width"))
def naive_ids_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = identifiers.naive_ids(_documents(spark, sf_dir), budget=320_000, pad=True, seed=SEED)
    value = F.col("new_docid").cast("bigint")
    return ids.agg(F.count("*").alias("n"), F.countDistinct("new_docid").alias("n_distinct"), F.bool_and((value >= 0) & (value < 320_000)).alias("in_range"), F.max(F.length("new_docid")).alias("width"))


@query(_UNIQUE.format(more="true AS version_4, CAST(32 AS INTEGER) AS width"))
def uuid4_ids_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = identifiers.uuid4_ids(_documents(spark, sf_dir), seed=SEED)
    return ids.agg(F.count("*").alias("n"), F.countDistinct("new_docid").alias("n_distinct"), F.bool_and(F.col("new_docid").rlike("^[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}$")).alias("version_4"), F.max(F.length("new_docid")).alias("width"))


@query(f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
i AS (SELECT range AS id, row_number() OVER (ORDER BY {_SHUF.format(seed=SEED, purpose='naive', key='range')}, range) AS n FROM range(320000))
SELECT CAST(doc_id AS VARCHAR) AS old_docid, lpad(CAST(id AS VARCHAR), 6, '0') AS new_docid FROM d JOIN i USING (n)
""")
def naive_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document by document: the numbers below the budget, in hashed order, dealt to the documents in theirs."""
    return identifiers.naive_ids(_documents(spark, sf_dir), budget=320_000, pad=True, seed=SEED)


_UUID = f"""
WITH h AS (SELECT doc_id, {_SHUF.format(seed=SEED, purpose='uuid4', key='doc_id')} AS h FROM documents),
u AS (SELECT doc_id, substr(h, 1, 12) || '4' || substr(h, 14, 3) || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 15) AS u FROM h)
"""


@query(_UUID + "SELECT CAST(doc_id AS VARCHAR) AS old_docid, u AS new_docid FROM u")
def uuid4_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.uuid4_ids(_documents(spark, sf_dir), seed=SEED)


@query(_UUID + """
SELECT CAST(doc_id AS VARCHAR) AS old_docid,
       CAST(CAST(CAST('0x' || substr(u, 1, 16) AS UBIGINT) AS UHUGEINT) * 18446744073709551616 + CAST('0x' || substr(u, 17, 16) AS UBIGINT) AS VARCHAR) AS new_docid FROM u
""")
def uuid4_decimal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same identifiers as decimal numbers of up to 39 digits."""
    return identifiers.uuid4_ids(_documents(spark, sf_dir), output="int", seed=SEED)


_SALTED = "CAST('0x' || substr(sha256(encode(docid) || unhex(lpad(to_hex(salt), 16, '0'))), 1, 16) AS UBIGINT)"
_SALTED_CODE = " || ".join(f"substr('{identifiers.ALPHABETS['base16']}', CAST(({_SALTED} >> {4 * k}) & 15 AS BIGINT) + 1, 1)" for k in range(4))


@query(f"""
WITH RECURSIVE s AS (
  SELECT CAST(doc_id AS VARCHAR) AS docid, doc_id AS o, CAST(0 AS BIGINT) AS salt, 0 AS round FROM documents
  UNION ALL
  SELECT docid, o, salt + lost, round + 1 FROM (
    SELECT *, max(lost) OVER () AS any_lost FROM (
      SELECT *, CASE WHEN o > min(o) OVER (PARTITION BY code) THEN 1 ELSE 0 END AS lost FROM (SELECT *, {_SALTED_CODE} AS code FROM s)))
  WHERE any_lost = 1)
SELECT docid AS old_docid, {_SALTED_CODE} AS new_docid, salt > 0 AS moved FROM s WHERE round = (SELECT max(round) FROM s)
""")
def hash_ids_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four hexadecimal digits: at 1,000 documents some collide, at 10,000 hundreds do, and take their next salts."""
    documents = _documents(spark, sf_dir)
    ids = identifiers.hash_ids(documents, length=4, alphabet="base16")
    first = documents.select(F.col("docid").alias("old_docid"), identifiers.hash_code(F.col("docid"), F.lit(0), identifiers.ALPHABETS["base16"], 4).alias("_first"))
    return ids.join(first, "old_docid").select("old_docid", "new_docid", (F.col("new_docid") != F.col("_first")).alias("moved"))


@query("SELECT count(*) AS n, count(*) AS n_distinct FROM embeddings")
def semantic_ids_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = semantic_ids(spark, sf_dir)
    return ids.agg(F.count("*").alias("n"), F.countDistinct("new_docid").alias("n_distinct"))


@query()
def semantic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("docid"), F.col("vec_id").alias(ORD), F.col("embedding").alias("vector"))
    return semantic.semantic_ids(rows)


# --- vectors


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) * 10000) AS BIGINT) AS VARCHAR)), ',') AS unit FROM embeddings")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.transform(vectors.l2_normalise(F.col("embedding")), lambda x: F.round(x * 10000).cast("bigint").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(unit, ",").alias("unit"))


@query("""
WITH q AS (SELECT vec_id AS t, embedding AS e FROM embeddings WHERE vec_id < 10),
s AS (SELECT v.vec_id AS qid, q.t, list_sum(list_transform(range(1, 65), lambda i: CAST(v.embedding[i] AS DOUBLE) * q.e[i])) AS s FROM embeddings v CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, t) AS r FROM s)
SELECT qid, string_agg(CAST(t AS VARCHAR), ',' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY qid
""")
def topk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector the five of ten fixed ones with the largest products: the ten are one small row."""
    rows = table(spark, sf_dir, "embeddings")
    fixed = rows.where("vec_id < 10").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("fixed"))
    scored = rows.join(F.broadcast(fixed)).select(F.col("vec_id").alias("qid"), F.transform("fixed", lambda f: f["vec_id"]).alias("ids"), F.transform("fixed", lambda f: vectors.dot(F.col("embedding"), f["embedding"])).alias("scores"))
    return scored.select("qid", F.array_join(vectors.top_k(F.col("scores"), F.col("ids"), 5).cast("array<string>"), ",").alias("top"))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.qid, v.vec_id AS t, list_sum(list_transform(range(1, 65), lambda i: CAST(v.embedding[i] AS DOUBLE) * q.e[i])) AS s FROM embeddings v CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, t) AS r FROM s)
SELECT qid, string_agg(CAST(t AS VARCHAR), ',' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY qid
""")
def topk_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors with the largest products, of all vectors, for every fiftieth one."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("v"))
    found = vectors.nearest_products(rows.where("id % 50 = 0"), rows, 5)
    return found.select(F.col("qid"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("top"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]))), 4) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def squared_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").select(F.col("embedding").alias("first"))
    return rows.join(F.broadcast(first)).select("vec_id", F.round(vectors.squared_distance(F.col("embedding"), F.col("first")), 4).alias("distance"))


# --- metrics

_RANKED = """
WITH p AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_partkey AS prediction FROM lineitem),
g AS (SELECT l_orderkey AS qid, min(l_partkey) AS gold FROM lineitem GROUP BY 1),
v AS (SELECT p_partkey FROM part WHERE p_size > 10),
d AS (SELECT qid, prediction, min(rank) AS rank, count(*) AS n, prediction IN (SELECT p_partkey FROM v) AS valid FROM p GROUP BY qid, prediction),
f AS (SELECT *, CASE WHEN valid THEN count(*) FILTER (valid) OVER (PARTITION BY qid ORDER BY rank) END AS place FROM d),
l AS (SELECT g.qid, g.gold, sum(n) AS n_predictions, coalesce(sum(n) FILTER (NOT valid), 0) AS n_invalid, min(place) FILTER (prediction = gold AND valid AND place <= 10) AS rank, min(rank) FILTER (prediction = gold) AS raw_rank FROM g JOIN f USING (qid) GROUP BY g.qid, g.gold)
"""


def _summary(prefix: str = "", rank: str = "rank") -> str:
    hits = ", ".join(f"round(sum(CASE WHEN {rank} <= {k} THEN 1.0 ELSE 0.0 END) / count(*), 6) AS {prefix}hits_at_{k}" for k in (1, 5, 10))
    return f"{hits}, round(sum(CASE WHEN {rank} <= 10 THEN CAST(1 AS DOUBLE) / {rank} ELSE 0 END) / count(*), 6) AS {prefix}mrr_at_10"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_RANKED + f"SELECT count(*) AS n, {_summary()}, {_summary('raw_', 'raw_rank')}, round(sum(n_invalid) / sum(n_predictions), 6) AS invalid_rate FROM l".replace("sum(CASE WHEN", "sum(CASE WHEN"))
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = metrics.ranked_lists(*tables.rankings(spark, sf_dir), depth=10)
    return _rounded(metrics.summarise(lists, raw=True))


@query(_RANKED + f"SELECT CASE WHEN gold IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') THEN 'seen' ELSE 'unseen' END AS bucket, count(*) AS n, {_summary()}, round(sum(n_invalid) / sum(n_predictions), 6) AS invalid_rate FROM l GROUP BY 1")
def seen_unseen_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = metrics.ranked_lists(*tables.rankings(spark, sf_dir), depth=10)
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").cast("string").alias("docid"), F.lit("query").alias("kind"))
    return _rounded(metrics.summarise(metrics.seen_and_unseen(lists, grouping.seen_targets(rows)), group="bucket"))


@query("""
WITH s AS (SELECT l_orderkey AS qid, l_partkey AS token_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, token_id) AS rank FROM s), g AS (SELECT l_orderkey AS qid, min(l_partkey) AS gold FROM lineitem GROUP BY 1),
l AS (SELECT g.qid, r.rank FROM g LEFT JOIN r ON r.qid = g.qid AND r.token_id = g.gold AND r.rank <= 5)
SELECT count(*) AS n, round(sum(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS hits_at_1, round(sum(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS hits_at_5, round(sum(CASE WHEN rank <= 5 THEN CAST(1 AS DOUBLE) / rank ELSE 0 END) / count(*), 6) AS mrr_at_5 FROM l
""")
def first_step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    scores = lines.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("token_id")).agg(F.max("l_extendedprice").alias("score"))
    gold = lines.groupBy(F.col("l_orderkey").alias("qid")).agg(F.min("l_partkey").alias("gold"))
    return _rounded(metrics.summarise(metrics.first_step_lists(scores, gold, 5), (1, 5), (5,)).drop("invalid_rate"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS target FROM part UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem")
def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parts(spark, sf_dir)
    return joins.valid_targets([rows.where("kind = 'document'"), rows.where("kind = 'query'")])


# --- html


@query()
def htmlnorm_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html_tree.normalise_pages("html").alias("n")).select("page_id", "n.tag", "n.title", "n.text")
