"""Stable row order. Spark rows have none, so operators that depend on it take an ordinal column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import materialise

ORD = "_ord"


def with_key_order(df: DataFrame, *keys: str, into: str = ORD) -> DataFrame:
    """The order of a unique key as the ordinal: no shuffle and no counting, the key itself is enough."""
    return df.withColumn(into, F.col(keys[0]).cast("bigint") if len(keys) == 1 else F.struct(*keys))


def with_dense_order(df: DataFrame, order: list[Column | str], into: str = ORD) -> DataFrame:
    """0, 1, 2, … in the given total order, without one task ever seeing all rows.

    Rows are range-partitioned, sorted and written; the partitions' sizes, one number each, give their offsets. They are written
    because the bounds of a range partitioning come from a sample: computed twice, they need not be the same.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low bits of this id are a row's place in its partition.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(ranged.select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "ranges")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(into, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def shuffle_key(seed: int | str, purpose: str, *keys: Column | str) -> Column:
    """A sort key that puts rows into a random order fixed by the seed, whatever the partitioning; break ties by the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def first_rows(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first n rows in an order; all rows if n is not positive."""
    return df.orderBy(*order).limit(n) if n > 0 else df
