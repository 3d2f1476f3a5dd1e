"""Lookup, semi and anti joins of corpus tables. All are equi-joins; Spark picks the strategy from the measured sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.operators.projections import require_columns


def remap_docids(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """docid := new_docid of the mapping (old_docid, new_docid); a docid that it lacks is an error when the rows are read."""
    if "docid" not in df.columns:
        return df
    m = mapping.select(F.col("old_docid").alias("_old"), F.col("new_docid").alias("_new"), F.lit(True).alias("_known"))
    joined = df.join(m, F.col("docid") == F.col("_old"), "left")
    new = F.when(F.col("_known"), F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("docid without a new id: "), F.coalesce("docid", F.lit("null")))).cast("string"))
    return joined.withColumn("docid", new).select(*df.columns)


def assign_identifiers(corpus: Corpus, mapping: DataFrame, updated: dict[str, DataFrame] | None = None, extra: dict[str, DataFrame] | None = None) -> Corpus:
    """All splits with the new docids, then the identifier plugin's own splits."""
    return corpus.map(lambda _, df: remap_docids(df, mapping)).merge(updated, extra)


def keep_docids(df: DataFrame, docids: DataFrame) -> DataFrame:
    return df.join(docids.select("docid").distinct(), "docid", "left_semi")


def skip_docids(df: DataFrame, docids: DataFrame) -> DataFrame:
    return df.join(docids.select("docid").distinct(), "docid", "left_anti")


def missing_docids(df: DataFrame, docids: DataFrame) -> DataFrame:
    """The docids asked for that a table lacks; no row means that all are there."""
    return docids.select("docid").distinct().join(df.select("docid"), "docid", "left_anti")


def validation_index(corpus: Corpus, check: bool = True) -> DataFrame:
    """docid, kind, text of the documents that validation queries ask for; a missing document is an error."""
    documents, queries = corpus[DOCUMENTS], corpus[VALIDATION_QUERIES]
    require_columns(DOCUMENTS, documents, ("docid", "text"))
    require_columns(VALIDATION_QUERIES, queries, ("docid",))
    if check and (lost := missing_docids(documents, queries).take(1)):
        raise ValueError(f"no document for the docid {lost[0][0]!r} of a validation query")
    return keep_docids(documents, queries).select("docid", F.lit("document").alias("kind"), "text")


def limit_corpus(corpus: Corpus, n: int, order: str = "_ord") -> Corpus:
    """The first n rows of each query split, and the documents that they refer to. n <= 0 limits nothing."""
    if n <= 0:
        return corpus
    cut = {name: corpus[name].orderBy(order).limit(n) for name in (TRAIN_QUERIES, VALIDATION_QUERIES)}
    used = cut[TRAIN_QUERIES].select("docid").union(cut[VALIDATION_QUERIES].select("docid"))
    return corpus.replace(**cut, **{DOCUMENTS: keep_docids(corpus[DOCUMENTS], used)})


def dangling_queries(corpus: Corpus) -> DataFrame:
    """split, docid of the queries whose document does not exist, docids compared as text."""
    known = corpus[DOCUMENTS].select(F.col("docid").cast("string"))
    parts = [corpus[s].select(F.lit(s).alias("split"), F.col("docid").cast("string").alias("docid")) for s in (TRAIN_QUERIES, VALIDATION_QUERIES)]
    return parts[0].unionByName(parts[1]).join(known, "docid", "left_anti").select("split", "docid")


def judged_pairs(qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct (qid, docid) of the relevant judgements whose document exists."""
    return qrels.where("relevance > 0").select("qid", "docid").distinct().join(documents.select("docid"), "docid", "left_semi").select("qid", "docid")


def judgement_stats(qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: rows, relevant rows, distinct pairs, those removed for want of a document, and queries left with none."""
    pairs = qrels.where("relevance > 0").select("qid", "docid").distinct()
    known = documents.select("docid", F.lit(1).alias("_known"))
    per_query = pairs.join(known, "docid", "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("_known").alias("kept"))
    sums = per_query.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.col("n") - F.col("kept")), F.lit(0)).alias("removed_pairs"),
        F.count_if(F.col("kept") == 0).alias("emptied_queries"),
    )
    rows = qrels.agg(F.count("*").alias("n_rows"), F.count_if(F.col("relevance") > 0).alias("positive_rows"))
    return rows.join(F.broadcast(sums))  # one row each


def query_rows(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """kind, query_id, text, docid: one row for each judged pair whose query is known. `sinks.write_sorted` writes them in order."""
    rows = pairs.join(queries.select(F.col("qid"), F.col("query")), "qid")
    return rows.select(F.lit("query").alias("kind"), F.col("qid").alias("query_id"), F.col("query").alias("text"), "docid")


def with_page_ids(df: DataFrame, revisions: DataFrame, oldid: Column, title: Column) -> DataFrame:
    """pageid of the revision, else a stable hash of the title: the first 15 hex digits of its MD5."""
    known = revisions.select(F.col("oldid").alias("_oldid"), F.col("pageid").alias("_pageid"))
    joined = df.withColumn("_rev", oldid).join(known, F.col("_rev") == F.col("_oldid"), "left")
    return joined.withColumn("pageid", F.coalesce("_pageid", F.conv(F.substring(F.md5(title), 1, 15), 16, 10).cast("bigint"))).drop("_rev", "_oldid", "_pageid")


def added_token_ids(tokens: DataFrame) -> DataFrame:
    """token, token_id = base_vocab_size + place, for a long token table (token, position, base_vocab_size)."""
    return tokens.select("token", (F.col("base_vocab_size") + F.col("position")).cast("int").alias("token_id"))


def duplicate_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")


def valid_targets(tables: list[DataFrame], tokens: DataFrame | None = None) -> DataFrame:
    """target: the added tokens if there are any, else the distinct trimmed docids of all tables."""
    if tokens is not None and tokens.take(1):
        return tokens.select(F.col("token").alias("target")).distinct()
    parts = [t.select(F.trim(F.col("docid").cast("string")).alias("target")) for t in tables if "docid" in t.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("target <> ''").distinct()


def resolve_token_init(payloads: DataFrame, vocabulary: DataFrame, dimension: int) -> DataFrame:
    """token, token_id, payload; a token without an id or with another dimension is an error when the rows are read."""
    joined = payloads.join(vocabulary.select("token", "token_id"), "token", "left")
    bad = F.raise_error(F.concat(F.lit("token cannot be initialised: "), F.col("token"))).cast("int")
    return joined.select("token", F.when(F.col("token_id").isNotNull() & (F.size("payload") == dimension), F.col("token_id")).otherwise(bad).alias("token_id"), "payload")
