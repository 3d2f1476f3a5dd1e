"""Reproducible sampling: shuffles by keyed hash, split sets, epoch samplers, shards.

Order comes from a hash of seed and key, never from a random generator, so results do not depend on partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions.ordinals import shuffle_key, with_dense_order
from quarry.operators.joins import keep_docids, skip_docids

EPOCH_STEP = 1_000_003


def shuffled(df: DataFrame, seed: int, key: str, purpose: str = "shuffle", into: str = "_shuffle") -> DataFrame:
    return df.withColumn(into, shuffle_key(seed, purpose, key))


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    if times < 1:
        raise ValueError(f"rows can be repeated once at least, not {times} times")
    return df if times == 1 else df.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_copy")).drop("_copy")


def select_queries(pool: DataFrame, size: int, seed: int, key: str, unique_docids: bool, skip: DataFrame | None = None) -> DataFrame:
    """`size` rows of the pool in shuffled order: none of the docids to skip, at most one for each docid if wanted.

    Fewer rows than asked for come back if the pool is short; `check_size` turns that into an error. A size of 0 selects nothing.
    """
    if size < 0:
        raise ValueError("a sample size cannot be negative here")
    rows = shuffled(pool if skip is None else skip_docids(pool, skip), seed, key, "select")
    if unique_docids:
        # The least row of each docid: an aggregate with a combiner, so a docid with very many queries is no hot window.
        columns = rows.columns
        rows = rows.groupBy("docid").agg(F.min_by(F.struct(*columns), F.struct("_shuffle", key)).alias("_row")).select("_row.*")
    return rows.orderBy("_shuffle", key).limit(size).drop("_shuffle")


def check_size(name: str, df: DataFrame, size: int) -> DataFrame:
    if (n := df.count()) != size:
        raise ValueError(f"{name}: {size} rows are wanted, {n} could be selected")
    return df


@dataclass(frozen=True)
class SplitSpec:
    name: str
    train: int
    validation: int
    unique_train_docids: bool = False


def split_set(corpus: Corpus, spec: SplitSpec, seed: int, key: str) -> Corpus:
    """Validation queries first, one for each docid; then train queries of other docids; then the documents of both.

    Sizes of -1 for both take the corpus as it is; -1 for one of them is an error.
    """
    if spec.train == spec.validation == -1:
        return corpus
    if -1 in (spec.train, spec.validation):
        raise ValueError(f"split set {spec.name!r}: either both sizes are -1 or none")
    pool = corpus[TRAIN_QUERIES].unionByName(corpus[VALIDATION_QUERIES])
    validation = select_queries(pool, spec.validation, seed, key, True)
    train = select_queries(pool, spec.train, seed, key, spec.unique_train_docids, validation)
    used = train.select("docid").union(validation.select("docid")).distinct()
    return corpus.replace(**{DOCUMENTS: keep_docids(corpus[DOCUMENTS], used), TRAIN_QUERIES: train, VALIDATION_QUERIES: validation})


def split_sets(corpus: Corpus, specs: list[SplitSpec], seed: int, key: str) -> dict[str, Corpus]:
    return {s.name: split_set(corpus, s, seed, key) for s in specs}


def one_query_per_document(rows: DataFrame, epoch: int, seed: int, key: str) -> DataFrame:
    """All documents and, for each docid, the (epoch mod n)-th of its n queries in an order fixed by the seed.

    The result carries `_shuffle`, the order of the epoch.
    """
    queries = rows.where("kind = 'query'").withColumn("_o", shuffle_key(seed, "per-document", "docid", key))
    # The order is by a hash, so its first two digits cut a docid's queries into 256 ordered parts of like size. Counts of the
    # parts, made by a combiner, say which part holds the wanted row, and only that part is ranked: a docid that has a third of
    # all queries is never one task's.
    queries = queries.withColumn("_part", F.substring("_o", 1, 2))
    counts = queries.groupBy("docid", "_part").agg(F.count("*").alias("_c"))
    mine = Window.partitionBy("docid")
    upto = F.sum("_c").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    wanted = counts.withColumn("_upto", upto).withColumn("_want", F.lit(epoch) % F.sum("_c").over(mine))
    part = wanted.where((F.col("_want") < F.col("_upto")) & (F.col("_want") >= F.col("_upto") - F.col("_c")))
    part = part.select("docid", "_part", (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_place"))
    ranked = queries.join(part, ["docid", "_part"]).withColumn("_r", F.row_number().over(mine.orderBy("_o", key)) - 1)
    picked = ranked.where(F.col("_r") == F.col("_place")).select(*rows.columns)
    both = rows.where("kind = 'document'").unionByName(picked)
    return shuffled(both, seed + EPOCH_STEP * (epoch + 1), key, "epoch")


def repeated_documents(rows: DataFrame, repeat: int | str, epoch: int, seed: int, key: str) -> DataFrame:
    """Queries once, documents `repeat` times or as often as they have queries (at least once), in the epoch's order."""
    documents, queries = rows.where("kind = 'document'"), rows.where("kind = 'query'")
    if repeat == "query":
        counts = queries.groupBy("docid").agg(F.count("*").alias("_times"))
        documents = documents.join(counts, "docid", "left").withColumn("_times", F.coalesce("_times", F.lit(1).cast("bigint")))
    else:
        documents = documents.withColumn("_times", F.lit(int(repeat)).cast("bigint"))
    copies = documents.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_copy")).drop("_times")
    both = copies.unionByName(queries.withColumn("_copy", F.lit(1).cast("bigint")))
    return both.withColumn("_shuffle", shuffle_key(seed + EPOCH_STEP * (epoch + 1), "epoch", key, "_copy"))


def shard(rows: DataFrame, rank: int, world: int, key: list[str]) -> DataFrame:
    """Every world-th row of the shuffled order, from the rank-th on."""
    placed = with_dense_order(rows, ["_shuffle", *key], "_pos")
    return placed.where(F.col("_pos") % world == rank).drop("_pos")


def steps_per_epoch(samples: int, batch: int, accumulation: int = 1, world: int = 1) -> int:
    return math.ceil(samples / max(1, batch * accumulation * world))


def warmup_steps(steps: int, epochs: int, explicit: int = 0, ratio: float = 0.0) -> int:
    return explicit if explicit > 0 else int(steps * epochs * ratio)


@dataclass(frozen=True)
class SamplingOptions:
    """Checked options of the samplers."""

    query_sampling: str = "none"
    document_repeat: int | str = 1
    query_max_tokens: int = 0
    train_queries_only: bool = False

    def __post_init__(self) -> None:
        if self.query_sampling not in ("none", "one-per-document"):
            raise ValueError(f"query_sampling is {self.query_sampling!r}, not none or one-per-document")
        if self.document_repeat != "query" and (not str(self.document_repeat).isdigit() or int(self.document_repeat) < 1):
            raise ValueError("document_repeat is a positive number or 'query'")
        if self.query_max_tokens < 0:
            raise ValueError("query_max_tokens cannot be negative")
        if self.query_sampling != "none" and self.document_repeat != 1:
            raise ValueError("query sampling and repeated documents exclude each other")
        if self.train_queries_only and (self.query_sampling != "none" or self.document_repeat != 1):
            raise ValueError("without documents there is nothing to sample by or to repeat")
