"""Connected components of a distributed edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) and m, the least neighbour of u. A node with very many edges is split by the adaptive skew join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge (a, b): the least node that can be reached from it.

    Loops and repeated edges do no harm; an empty edge list has no components. Rounds are written to the shared folder, so a lost
    executor costs one round at most, and no round brings rows to the driver.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    stars = materialise(edges.where(F.col("a") != F.col("b")).select(b.alias("u"), a.alias("v")).distinct(), "edges")
    before = _mark(stars)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).withColumn("m", F.least("m", "u")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        joined = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        stars = materialise(joined.distinct(), "edges")
        after = _mark(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    nodes = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
