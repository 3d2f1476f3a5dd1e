"""Pieces that several operators of this subpackage share: hold-out rule, shared storage, session clean-up."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import materialise, new_path  # noqa: F401

#: Folds of the hold-out rule; fold 0 is held out.
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def is_held_out(doc_id: Column) -> Column:
    """True for the rows from which no label may be learned (a null id is held out, too)."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name like this one that no column in `taken` has, whatever its case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """At most n rows in an Arrow batch for what is executed inside: bounds a task's memory where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def highest_rank(n: int, bound: int) -> int:
    """The signed 64-bit hash below which about 2 * bound of n rows lie: never fewer than bound, but for a negligible chance."""
    return min((1 << 63) - 1, -(1 << 63) + (2 * bound << 64) // max(n, 1))


def labelled_sample(docs: DataFrame, labels: DataFrame | None, target: str, bound: int, seed: int = 17) -> list[tuple[int, str, object]]:
    """At most `bound` training rows (id, text, target), the same for any partitioning.

    Rows of the held-out fold, rows without text and rows without a target never take part. The ids with the lowest keyed hash are
    taken, so that a fit sees all sources and sizes; `bound` is the documented limit of the fit. An id with several targets has the
    least one, an id with several texts the least one. Two passes over the ids and one over the texts, whatever the partitions.
    """
    rank = F.xxhash64(F.col("doc_id"), F.lit(seed))
    ids = (docs if labels is None else labels).where(~is_held_out(F.col("doc_id")) & F.col(target).isNotNull()).select("doc_id", F.col(target).alias("_target"))
    n = ids.count()
    if n > 4 * bound:
        ids = ids.where(rank <= F.lit(highest_rank(n, bound)))
    chosen = ids.groupBy("doc_id").agg(F.min("_target").alias("_target")).orderBy(rank, "doc_id").limit(bound)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_target").alias("_target")).collect()
    return sorted(((r[0], r[1], r[2]) for r in rows), key=lambda r: r[0])
