"""Registered queries of subword ids, each with its SQL.

Their vocabulary is made of the words of `benchmark`: whole words, their first three letters, what follows these, and single
characters. SQL matches it word by word, with a recursion that takes off the longest piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, Corpus
from quarry.functions import keys
from quarry.functions.ordinals import with_dense_order
from quarry.operators import subwords, tokens
from quarry.operators.subwords import JOINTS, Vocabulary
from quarry.plans.catalogue import query
from quarry.plans.tables import table


def vocabulary(spark: SparkSession, sf_dir: str) -> Vocabulary:
    texts = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).distinct()
    marks = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[!-/:-@\[-`{-~]"), F.lit(0))).alias("piece"))
    letters = words.select(F.explode(F.split("w", "")).alias("c")).where("c <> ''")
    rest = F.substring("w", F.lit(4), F.length("w"))
    pieces = (
        words.select(F.explode(F.array("w", F.substring("w", 1, 3), F.when(rest != "", F.concat(F.lit("##"), rest)))).alias("piece"))
        .unionByName(letters.select(F.explode(F.array("c", F.concat(F.lit("##"), "c"))).alias("piece"))).unionByName(marks)
    )
    numbered = with_dense_order(pieces.where("piece is not null").distinct(), ["piece"], "n")
    special = spark.createDataFrame([("[SEP]", 1), ("[UNK]", 2)], "piece string, id int")
    return Vocabulary.of(numbered.select("piece", (F.col("n") + 3).cast("int").alias("id")).unionByName(special))


_VOCABULARY = r"""
bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
pieces AS (
    SELECT w AS piece FROM bw UNION SELECT substr(w, 1, 3) FROM bw UNION SELECT '##' || substr(w, 4) FROM bw WHERE length(w) > 3
    UNION SELECT unnest(string_split(w, '')) FROM bw UNION SELECT '##' || unnest(string_split(w, '')) FROM bw
    UNION SELECT unnest(regexp_extract_all(lower(text), '[!-/:-@\[-`{-~]')) FROM benchmark),
voc AS (SELECT piece, CAST(row_number() OVER (ORDER BY piece) + 2 AS INTEGER) AS id FROM pieces WHERE piece NOT IN ('', '##'))
"""

#: rows(k, text) -> ids(k, ids, shown): the rows' words, each different one matched once.
_MATCHED = rf"""
words AS (
    SELECT k, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place
    FROM (SELECT k, regexp_extract_all(regexp_replace(text, '{subwords.CONTROL}', '', 'g'), '{subwords.WORD}') AS ws FROM rows)),
plain AS (SELECT word, strip_accents(lower(word)) AS norm FROM (SELECT DISTINCT word FROM words)),
m AS (
    SELECT norm, norm AS rest, '' AS lead, CAST([] AS INTEGER[]) AS ids FROM (SELECT DISTINCT norm FROM plain WHERE length(norm) <= 100)
    UNION ALL
    SELECT norm, arg_max(substr(rest, cut + 1), cut), '##', arg_max(list_append(ids, id), cut)
    FROM (SELECT *, unnest(range(1, length(rest) + 1)) AS cut FROM m WHERE rest <> '') JOIN voc ON piece = lead || substr(rest, 1, cut) GROUP BY norm),
matched AS (
    SELECT word, CASE WHEN norm = '' THEN CAST([] AS INTEGER[]) ELSE coalesce(m.ids, [2]) END AS ids,
           CASE WHEN norm <> '' THEN CASE WHEN m.ids IS NULL THEN '[UNK]' ELSE norm END END AS shown
    FROM plain LEFT JOIN (SELECT norm, ids FROM m WHERE rest = '') m USING (norm)),
ids AS (
    SELECT k, coalesce(flatten(list(ids ORDER BY place) FILTER (word IS NOT NULL)), []) AS ids, coalesce(list(shown ORDER BY place) FILTER (shown IS NOT NULL), []) AS shown
    FROM (SELECT DISTINCT k FROM rows) LEFT JOIN words USING (k) LEFT JOIN matched USING (word) GROUP BY k)
"""


def _matched(rows: str, result: str) -> str:
    return f"WITH RECURSIVE {_VOCABULARY}, rows AS ({rows}), {_MATCHED} {result}"


def _sql_shown() -> str:
    out = "array_to_string(shown, ' ')"
    for apart, joined in JOINTS:
        out = f"replace({out}, '{apart.replace(chr(39), chr(39) * 2)}', '{joined.replace(chr(39), chr(39) * 2)}')"
    return f"trim({out})"


@query(_matched(
    "SELECT doc_id AS k, coalesce(text, '') AS text FROM documents",
    """SELECT k AS doc_id, CAST(len(ids) AS INTEGER) AS n_ids, CAST(len(list_filter(ids, lambda x: x = 2)) AS INTEGER) AS n_unknown,
              md5(array_to_string(ids, ',')) AS ids_md5 FROM ids""",
))
def wordpiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subword ids of every whole document."""
    v = vocabulary(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", v.words("text").alias("words"))
    ids = subwords.encode(docs, ["doc_id"], "words", v)
    unknown = F.filter("ids", lambda x: x == v.unk_id)
    return ids.select("doc_id", F.size("ids").alias("n_ids"), F.size(unknown).alias("n_unknown"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query(_matched(
    "SELECT DISTINCT t AS k, t AS text FROM (SELECT unnest([substr(text, 1, 256), lower(substr(text, 1, 256))]) AS t FROM documents)",
    """SELECT doc_id, md5(array_to_string(u.ids[1:32], ',')) AS uncased, md5(array_to_string(c.ids[1:32], ',')) AS cased
       FROM documents JOIN ids u ON u.k = lower(substr(text, 1, 256)) JOIN ids c ON c.k = substr(text, 1, 256)""",
))
def tokens_32_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplication keys of the first 32 subword ids."""
    v = vocabulary(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias(keys.TEXT))
    for method, into in (("tokens-32", "uncased"), ("tokens-32-cased", "cased")):
        rows = keys.with_subwords(rows, method, v)
        rows = rows.withColumn(into, keys.key_for(method, rows.columns, v)).drop(keys.SUBWORDS)
    return rows.drop(keys.TEXT)


_TITLES = r"trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\s+', ' ', 'g'))"
_HEADINGS = r"trim(CASE WHEN instr(html, '<h1>') > 0 AND instr(substr(html, instr(html, '<h1>') + 4), '</h1>') > 0 THEN split_part(substr(html, instr(html, '<h1>') + 4), '</h1>', 1) ELSE '' END)"


@query(_matched(
    f"SELECT DISTINCT t AS k, t AS text FROM (SELECT unnest([{_TITLES}, {_HEADINGS}]) AS t FROM pages)",
    f"SELECT page_id, md5({_sql_shown().replace('shown', 't.shown')}) AS title_key, md5({_sql_shown().replace('shown', 'h.shown')}) AS heading_key FROM pages JOIN ids t ON t.k = {_TITLES} JOIN ids h ON h.k = {_HEADINGS}",
))
def nci_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of pages: their titles and first headings as subwords give them back."""
    v = vocabulary(spark, sf_dir)
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), r"\s+", " "))
    marked = F.replace(F.replace("html", F.lit("<h1>"), F.lit("<H1>")), F.lit("</h1>"), F.lit("</H1>"))
    rows = table(spark, sf_dir, "pages").select("page_id", title.alias(keys.NCI), marked.alias(keys.TEXT))
    for method, into in (("ncititle", "title_key"), ("nci-h1", "heading_key")):
        rows = keys.with_subwords(rows, method, v)
        rows = rows.withColumn(into, keys.key_for(method, rows.columns, v)).drop(keys.SUBWORDS)
    return rows.select("page_id", "title_key", "heading_key")


_TOKEN_ROWS = """
SELECT 'documents' AS split, CAST(doc_id AS VARCHAR) AS docid, coalesce(text, '') AS text FROM documents
UNION ALL SELECT 'train_queries', conv_id || '.' || turn, split_part(coalesce(text, ''), ' ', 1) FROM conversations
"""


@query(_matched(
    f"SELECT DISTINCT t AS k, t AS text FROM (SELECT unnest([text, docid]) AS t FROM ({_TOKEN_ROWS}))",
    f"""SELECT split, docid, array_to_string(list_append(CASE WHEN split = 'documents' THEN t.ids[1:32] ELSE t.ids END, 1), ',') AS text_tokens,
               array_to_string(list_append(d.ids, 1), ',') AS docid_tokens
        FROM ({_TOKEN_ROWS}) r JOIN ids t ON t.k = r.text JOIN ids d ON d.k = r.docid""",
))
def subword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token columns of documents and of the first words of turns, with the limits of the tokenizer step."""
    v = vocabulary(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("docid"), F.split_part("text", F.lit(" "), F.lit(1)).alias("text"))
    out = tokens.tokenise(Corpus({DOCUMENTS: docs, TRAIN_QUERIES: turns}), v)
    joined = [F.array_join(c, ",").alias(c) for c in ("text_tokens", "docid_tokens")]
    rows = [out[s].select(F.lit(s).alias("split"), "docid", *joined) for s in out]
    return rows[0].unionByName(rows[1])
