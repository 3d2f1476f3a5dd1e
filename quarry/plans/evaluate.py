"""The driver around the metrics: an export, a table of predictions and their targets in; a report of all cut-offs out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import grouping, joins, metrics
from quarry.schemas import TRAINING
from quarry.sources import readers, sinks
from quarry.storage import materialise

BUCKETS = ("all", "seen", "unseen")
MEASURES = ("hits", "mrr", "raw_hits", "raw_mrr", "invalid_rate")
#: Rows of an export for evaluation carry their query's id.
EVALUATION = f"{TRAINING}, qid STRING"


def report(lists: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """bucket (all, seen, unseen), k, n, hits, mrr, raw_hits, raw_mrr, invalid_rate: a row for each bucket and cut-off.

    lists: the ranked lists with their bucket. One pass: each list is expanded by cut-off, and grouping sets make all three buckets of
    it, with partial sums. A bucket without queries has a row of zeros.
    """
    cut = lists.select("bucket", "rank", "raw_rank", "n_invalid", "n_predictions", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hit = lambda rank: F.sum((F.col(rank) <= F.col("k")).cast("double"))
    reciprocal = lambda rank: F.sum(F.when(F.col(rank) <= F.col("k"), 1.0 / F.col(rank)))
    sums = cut.groupingSets([["k"], ["k", "bucket"]], "k", "bucket").agg(
        F.when(F.grouping("bucket") == 1, "all").otherwise(F.col("bucket")).alias("name"), F.count("*").alias("n"), hit("rank").alias("hits"), reciprocal("rank").alias("mrr"),
        hit("raw_rank").alias("raw_hits"), reciprocal("raw_rank").alias("raw_mrr"), F.sum("n_invalid").alias("invalid"), F.sum("n_predictions").alias("shown"),
    )
    grid = lists.sparkSession.createDataFrame([(b, k) for b in BUCKETS for k in ks], "bucket string, k int")
    found = sums.select(F.col("name").alias("_b"), F.col("k").alias("_k"), "n", "hits", "mrr", "raw_hits", "raw_mrr", "invalid", "shown")
    joined = grid.join(found, (F.col("bucket") == F.col("_b")) & (F.col("k") == F.col("_k")), "left")
    n = F.coalesce("n", F.lit(0))
    share = lambda c: (F.coalesce(c, F.lit(0.0)) / F.greatest(n, F.lit(1))).alias(c)
    invalid = F.coalesce("invalid", F.lit(0)) / F.greatest(F.coalesce("shown", F.lit(0)), F.lit(1))
    return joined.select("bucket", "k", n.alias("n"), share("hits"), share("mrr"), share("raw_hits"), share("raw_mrr"), invalid.alias("invalid_rate"))


def named(rows: DataFrame, prefix: str = "eval") -> dict[str, float]:
    """A report as one mapping of names to numbers, for sinks and trackers."""
    out: dict[str, float] = {}
    for r in rows.collect():  # a row for each bucket and cut-off
        head = prefix if r["bucket"] == "all" else f"{prefix}_{r['bucket']}"
        out[f"{head}_n"], out[f"{head}_invalid_rate"] = r["n"], r["invalid_rate"]
        for m in MEASURES[:-1]:
            out[f"{head}_{m}_at_{r['k']}"] = r[m]
    return out


def _rows(spark: SparkSession, folder: str, split: str, fmt: str) -> DataFrame | None:
    writer, suffix = sinks.FORMATS[fmt]
    path = f"{folder}/{split}{suffix}"
    return spark.read.schema(EVALUATION).format(writer).load(path) if readers.exists(spark, path) else None


def evaluate(
    spark: SparkSession, folder: str, predictions: DataFrame, tokens: DataFrame | None = None, split: str = "validation", others: tuple[str, ...] = ("train", "validation_index"),
    ks: tuple[int, ...] = (1, 5, 10), fmt: str = "jsonl", output: str = "", history: str = "", prefix: str = "eval",
) -> DataFrame:
    """The report of predictions (qid, rank, prediction) for the queries of an export's split.

    Valid targets are the added tokens, or the docids of all splits; a target is seen if a train query has it. The report is written
    as JSON to `output` and appended to `history`, if they are given.
    """
    found = {name: rows for name in (split, *others) if (rows := _rows(spark, folder, name, fmt)) is not None}
    if split not in found:
        raise FileNotFoundError(f"{folder} has no split {split!r}")
    queries = found[split].where("kind = 'query'")
    if queries.where("qid is null").take(1):
        raise ValueError(f"queries of {split!r} need a qid")
    gold = queries.select("qid", F.col("docid").alias("gold"))
    lists = metrics.ranked_lists(predictions, gold, joins.valid_targets(list(found.values()), tokens), max(ks))
    seen = grouping.seen_targets(found["train"]) if "train" in found else gold.select(F.col("gold").alias("target")).where("false")
    out = materialise(report(metrics.seen_and_unseen(lists, seen), ks), "evaluation")
    if output or history:
        values = named(out, prefix)
        if output:
            sinks.write_metrics(spark, values, output)
        if history:
            sinks.append_metrics(spark, values, history, prefix)
    return out
