"""Ranked-list metrics: hits@k, mrr@k, invalid rate, raw and filtered, for all queries and for seen and unseen targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Predictions whose lists one task makes, about.
TASK_ROWS = 1 << 19


def ranked_lists(predictions: DataFrame, gold: DataFrame, targets: DataFrame, depth: int, raw_depth: int | None = None) -> DataFrame:
    """qid, gold, n_predictions, n_invalid, rank (of gold among the valid different predictions, first `depth`), raw_rank.

    predictions: qid, rank, prediction. Every query of gold has a row, with or without predictions. Duplicates count as invalid as
    often as they come. Only rows of one query meet in a window, a list as long as its beam. Lists are dealt to as many tasks as it
    takes for each to have about TASK_ROWS predictions, so what a task holds does not grow with the table.
    """
    shown = predictions.select("qid", "rank", F.trim(F.col("prediction").cast("string")).alias("prediction"))
    valid = targets.select(F.col("target").alias("prediction"), F.lit(True).alias("_valid")).distinct()
    marked = shown.join(valid, "prediction", "left")
    answers = gold.select("qid", F.trim(F.col("gold").cast("string")).alias("gold"))
    tasks = -(-predictions.count() // TASK_ROWS)
    if tasks > int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        marked, answers = marked.repartition(tasks, "qid"), answers.repartition(tasks, "qid")
    joined = marked.join(answers.withColumnRenamed("qid", "_q"), F.col("qid") == F.col("_q")).drop("_q")
    best = joined.groupBy("qid", "gold", "prediction").agg(F.min("rank").alias("rank"), F.count("*").alias("n"), F.bool_or(F.coalesce("_valid", F.lit(False))).alias("valid"))
    place = F.sum(F.col("valid").cast("int")).over(Window.partitionBy("qid").orderBy("rank", "prediction").rowsBetween(Window.unboundedPreceding, 0))
    hit = (F.col("prediction") == F.col("gold"))
    per = best.withColumn("place", place).groupBy("qid").agg(
        F.sum("n").alias("n_predictions"), F.coalesce(F.sum(F.when(~F.col("valid"), F.col("n"))), F.lit(0)).alias("n_invalid"),
        F.min(F.when(hit & F.col("valid") & (F.col("place") <= depth), F.col("place"))).alias("rank"),
        F.min(F.when(hit, F.col("rank"))).alias("raw_rank"),
    )
    return answers.join(per, "qid", "left")


def _share(total: Column, n: Column) -> Column:
    return F.coalesce(total, F.lit(0.0)) / F.greatest(n, F.lit(1))


def summarise(lists: DataFrame, ks: tuple[int, ...] = (1, 5, 10), mrr_ks: tuple[int, ...] = (10,), raw: bool = False, group: str | None = None) -> DataFrame:
    """One row (for each group): n, hits_at_k, mrr_at_k, invalid_rate; with `raw` also those of the unfiltered lists.

    Sums are partial on the executors. A group without queries has no row; without a group there is always one.
    """
    n = F.count("*")
    out = [n.alias("n")]
    for name, rank in (("", "rank"), *((("raw_", "raw_rank"),) if raw else ())):
        out += [_share(F.sum((F.col(rank) <= k).cast("double")), n).alias(f"{name}hits_at_{k}") for k in ks]
        out += [_share(F.sum(F.when(F.col(rank) <= k, 1.0 / F.col(rank)).otherwise(0.0)), n).alias(f"{name}mrr_at_{k}") for k in mrr_ks]
    invalid = F.coalesce(F.sum("n_invalid"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n_predictions"), F.lit(0)), F.lit(1))
    out.append(invalid.alias("invalid_rate"))
    return (lists.groupBy(group) if group else lists.groupBy()).agg(*out)


def seen_and_unseen(lists: DataFrame, seen: DataFrame) -> DataFrame:
    """The lists with `bucket`: seen or unseen, by their gold target."""
    known = seen.select(F.col("target").alias("gold"), F.lit(True).alias("_seen")).distinct()
    return lists.join(known, "gold", "left").withColumn("bucket", F.when(F.col("_seen"), "seen").otherwise("unseen")).drop("_seen")


def first_step_lists(scores: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """qid, gold, rank of gold among the `depth` best scores of a first decoding step. scores: qid, token_id, score.

    Queries without a gold label are left out. Ties go to the smaller id.
    """
    mine = Window.partitionBy("qid").orderBy(F.desc("score"), "token_id")
    top = scores.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= depth)
    labels = gold.where("gold is not null")
    found = top.join(labels, (top["qid"] == labels["qid"]) & (top["token_id"] == labels["gold"])).select(labels["qid"].alias("_q"), "rank")
    return labels.join(found, labels["qid"] == F.col("_q"), "left").select("qid", "gold", "rank", F.lit(0).alias("n_invalid"), F.lit(depth).alias("n_predictions"))


def json_ready(column: Column | str) -> Column:
    """A double as text that JSON can hold: NaN and infinities by name."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(c.cast("string"))
