"""Tables that cut a lineage: written to the folder which all executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no shared folder")
    path = "file://" + tempfile.mkdtemp(prefix="quarry-tables-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_written() -> None:
    while _written:
        try:
            drop_path(*_written.pop())
        except Exception:  # the JVM may be gone at exit; the folder is then the cluster's to clean
            return


atexit.register(_drop_written)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_folder(spark).rstrip('/')}/quarry-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """One small file, wherever Spark can write it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back. Unlike a cached or locally checkpointed frame it survives the loss of any
    executor."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
