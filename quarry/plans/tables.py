"""The driver's tables as the collections that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions.ordinals import ORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as question examples: every tenth is validation, the question is the first line."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"), F.col("doc_id").alias(ORD), F.substring_index("text", "\n", 1).alias("question_text"), F.col("text").alias("document_text"),
        F.lit("").alias("document_url"), F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split"),
    )


def customers(spark: SparkSession, sf_dir: str) -> Corpus:
    """Customers as documents, orders as queries; every tenth order is validation."""
    documents = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("docid"), F.lit("document").alias("kind"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"), F.col("c_name").alias("title"), F.col("c_custkey").alias(ORD)
    )
    queries = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("docid"), F.lit("query").alias("kind"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("text"), F.lit("").alias("title"), F.col("o_orderkey").alias(ORD)
    )
    return Corpus({DOCUMENTS: documents, TRAIN_QUERIES: queries.where(F.col(ORD) % 10 != 0), VALIDATION_QUERIES: queries.where(F.col(ORD) % 10 == 0)})


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as document rows and line items as query rows: docid, kind, key (unique text)."""
    documents = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("docid"), F.lit("document").alias("kind"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("key"))
    lines = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), cents)
    return documents.unionByName(lines.select(F.col("l_partkey").cast("string").alias("docid"), F.lit("query").alias("kind"), key.alias("key")))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, docid, relevance of line items: returned ones are not relevant."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("docid"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("relevance"))


def rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, gold, targets): an order's parts as its ranked list, its least part as the answer, large parts as valid."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    predictions = lines.select(F.col("l_orderkey").alias("qid"), F.row_number().over(order).alias("rank"), F.col("l_partkey").cast("string").alias("prediction"))
    gold = lines.groupBy(F.col("l_orderkey").alias("qid")).agg(F.min("l_partkey").cast("string").alias("gold"))
    targets = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("target"))
    return predictions, gold, targets
