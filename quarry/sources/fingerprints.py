"""What tables and files hold, as digests that do not depend on the order of rows.

A row's hash is taken from all its columns by name; the hashes are added up, so a digest is one aggregate with a combiner. Digests of
files are kept, one row a file, with the file's length and time: only files that are new or changed are read again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.readers import exists

_KNOWN = "path string, length bigint, modified timestamp, n bigint, h1 decimal(38,0), h2 decimal(38,0)"


def _sums(row: F.Column) -> list[F.Column]:
    """Two independent sums of 64-bit hashes, and the number of rows."""
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return [F.count("*").alias("n"), total(F.xxhash64(row)).alias("h1"), total(F.xxhash64(row, F.lit(1))).alias("h2")]


def _digest(*parts: object) -> str:
    return hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()


def content(df: DataFrame) -> str:
    """The digest of a table: its columns, their types, and its rows as a bag."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return _digest(sorted((f.name, f.dataType.simpleString()) for f in df.schema), *df.agg(*_sums(row)).first())


class Fingerprints:
    """Digests of files under a folder that holds what is known of them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.table = spark, f"{root}/fingerprints"

    def _known(self) -> DataFrame:
        there = exists(self.spark, self.table)
        return self.spark.read.schema(_KNOWN).parquet(self.table) if there else self.spark.createDataFrame([], _KNOWN)

    def files(self, path: str) -> DataFrame:
        """path, length, modified of every file below a path."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return listed.select(F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified"))

    def _read(self, paths: list[str]) -> DataFrame:
        """path, row: the rows of Parquet files, the lines of all others. Files of one folder are read as one table."""
        parquet: dict[str, list[str]] = {}
        for p in paths:
            if p.endswith(".parquet"):
                parquet.setdefault(p.rpartition("/")[0], []).append(p)
        tables = [self.spark.read.parquet(*some) for some in parquet.values()]
        rows = [t.select(F.col("_metadata.file_path").alias("path"), F.to_json(F.struct(*sorted(t.columns)), {"ignoreNullFields": "false"}).alias("row")) for t in tables]
        if lines := [p for p in paths if not p.endswith(".parquet")]:
            rows.append(self.spark.read.text(lines).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("row")))
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    def of(self, path: str) -> str:
        """The digest of all that the files below a path hold, wherever they lie and however their rows are dealt to them."""
        if not exists(self.spark, path):
            return _digest("nothing")
        now, same = self.files(path), ["path", "length", "modified"]
        if changed := [r[0] for r in now.join(self._known(), same, "left_anti").select("path").collect()]:  # a row a file
            sums = self._read(changed).groupBy("path").agg(*_sums(F.col("row")))
            found = now.where(F.col("path").isin(changed)) if len(changed) < 1000 else now.join(self._known(), same, "left_anti")
            empty = [F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("n", "bigint"), ("h1", "decimal(38,0)"), ("h2", "decimal(38,0)"))]
            found.join(sums, "path", "left").select(*same, *empty).write.mode("append").parquet(self.table)
        known = self._known().groupBy(*same).agg(F.max("n").alias("n"), F.max("h1").alias("h1"), F.max("h2").alias("h2"))
        return _digest(*now.join(known, same).agg(F.sum("n"), F.sum("h1"), F.sum("h2")).first())
