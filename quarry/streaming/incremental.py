"""The streaming counterparts of two batch operators, for collections that keep growing.

The engine's sources are finite; these let a directory of arriving files be deduplicated and counted as it grows, with bounded state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.keys import md5_key


def arriving(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_at_a_time: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).format(fmt).load(folder)


def first_of_key(stream: DataFrame, key: Column, time: str, lateness: str) -> DataFrame:
    """The first row of each key within the lateness; state is dropped behind the watermark."""
    return stream.withColumn("_key", md5_key(key)).withWatermark(time, lateness).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def counts_by_window(stream: DataFrame, time: str, window: str, lateness: str, group: str) -> DataFrame:
    """n and the sum of value of each group in tumbling windows; a window's row comes once the watermark has passed it."""
    grouped = stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), group)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")
