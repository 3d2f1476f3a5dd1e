"""Vector and ranked-list scalars on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Divided by the norm; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def divide(v: Column, n: Column) -> Column:
    return F.transform(v, lambda x: x / n)


def reciprocal_rank(predictions: Column, gold: Column, k: int) -> Column:
    """1 / place of the first match among the first k, else 0."""
    at = F.array_position(F.slice(predictions, 1, k), gold)
    return F.coalesce(F.lit(1.0) / F.nullif(at, F.lit(0).cast("bigint")), F.lit(0.0))


def top_k(scores: Column, ids: Column, k: int) -> Column:
    """The ids of the k largest scores, best first; ties go to the smaller id."""
    pairs = F.zip_with(ids, scores, lambda i, s: F.struct(s.cast("double").alias("s"), i.alias("i")))
    order = lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)
    return F.transform(F.slice(F.array_sort(pairs, order), 1, k), lambda p: p["i"])


def nearest_products(queries: DataFrame, rows: DataFrame, k: int, block: int = 256, chunk: int = 2048) -> DataFrame:
    """qid and the ids (array, best first, ties to the smaller) of the k rows with the largest products, for every query against all
    rows. queries, rows: id long, v array. Blocks of queries meet chunks of rows, each pair hands on its k best for a query.
    """
    import numpy as np
    import pyarrow as pa

    def packed(df: DataFrame, size: int, name: str) -> DataFrame:
        n = -(-df.count() // size) or 1
        group = F.pmod(F.xxhash64("id"), F.lit(n))
        return df.groupBy(group.alias("g")).agg(F.collect_list(F.struct("id", F.col("v").cast("array<double>").alias("v"))).alias(name)).drop("g")

    def arrays(side: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of a row's list, in the order of the ids, without a Python object for a number."""
        rows = side[k].values
        ids, v = rows.field("id").to_numpy(zero_copy_only=False), rows.field("v")
        matrix = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], matrix[order]

    def best(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                (qids, a), (ids, b) = arrays(batch.column(0), at), arrays(batch.column(1), at)
                total = np.zeros((len(qids), len(ids)))
                for j in range(a.shape[1]):  # in the order of the dimensions, so that equal vectors have equal products
                    total += a[:, j, None] * b[None, :, j]
                top = np.argsort(-total, axis=1, kind="stable")[:, :k]
                found = (np.repeat(qids, top.shape[1]), ids[top].reshape(-1), np.take_along_axis(total, top, 1).reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["qid", "id", "s"])

    pairs = packed(queries, block, "q").crossJoin(packed(rows, chunk, "r")).select("q", "r").repartition(F.xxhash64("q", "r"))
    found = pairs.mapInArrow(best, "qid long, id long, s double").groupBy("qid").agg(F.collect_list("id").alias("ids"), F.collect_list("s").alias("s"))
    return found.select("qid", top_k(F.col("s"), F.col("ids"), k).alias("ids"))
