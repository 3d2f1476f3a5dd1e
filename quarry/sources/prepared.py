"""Prepared splits kept as gzipped JSON beside their collection: probed file by file before they are trusted, replaced as a whole."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schemas import PREPARED
from quarry.sources.readers import _fs, exists

_PROBED = "path string, length bigint, damage string, n_lines bigint, fields array<string>"
_STEP = 1 << 20


def _read_through(body: bytes, gzipped: bool) -> tuple[str | None, int, list[str]]:
    """(damage, lines, fields of the first line) of a file that is read to its end in small steps."""
    first, lines, last, damage = b"", 0, b"\n", None
    stream, rest = zlib.decompressobj(31), body
    while rest:
        if gzipped:
            try:
                piece = stream.decompress(rest, _STEP)
            except zlib.error as error:
                damage = f"not gzip: {error}"
                break
            rest = stream.unconsumed_tail or stream.unused_data
            if stream.eof and rest:
                stream = zlib.decompressobj(31)
            elif not stream.eof and not rest and not piece:
                break
        else:
            piece, rest = rest[:_STEP], rest[_STEP:]
        if not lines and len(first) < _STEP:
            first += piece
        lines += piece.count(b"\n")
        last = piece[-1:] or last
    if gzipped and damage is None and body and not stream.eof:
        damage = "cut short"
    if damage is None and last != b"\n":
        damage = "the last line has no end"
    try:
        row = json.loads(first.split(b"\n", 1)[0]) if first.strip() else {}
        fields = sorted(row)
    except (ValueError, TypeError):
        damage, fields = damage or "the first line is no JSON object", []
    return damage, lines, fields


def probe(spark: SparkSession, path: str) -> DataFrame:
    """path, length, damage (null if there is none), n_lines, fields (of the first line): a row for each file of a split.

    The files' bytes come by Spark, so they may lie where only Spark reads; a file is one row and never more than one task's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [_read_through(bytes(b), p.endswith(".gz")) for p, b in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "damage": [r[0] for r in read], "n_lines": [r[1] for r in read], "fields": [r[2] for r in read]})

    path_of = F.col("_metadata.file_path").alias("path")
    listed = spark.read.format("binaryFile").load(path).select(path_of, "length")
    # A file that can't be read at all gives no row here, and is missed in the list.
    bodies = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(path).select(path_of, "length", "content")
    read = bodies.mapInPandas(run, _PROBED).withColumn("_read", F.lit(True)).drop("length")
    damage = F.when(F.col("_read").isNull(), F.lit("unreadable")).otherwise(F.col("damage"))
    return listed.join(read, "path", "left").select("path", "length", damage.alias("damage"), "n_lines", "fields")


def fault(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> str | None:
    """Why the split at a path can't be used: `missing`, `damaged`, `lacks a, b`; None if it can."""
    if not exists(spark, path):
        return "missing"
    filled = probe(spark, path).where("length > 0")
    lacking = [F.count_if((F.col("n_lines") > 0) & ~F.array_contains("fields", name)).alias(name) for name in required]
    row = filled.agg(F.count("damage").alias("_damaged"), *lacking).first()
    if row["_damaged"]:
        return "damaged"
    lost = [name for name in required if row[name]]
    return f"lacks {', '.join(lost)}" if lost else None


def commit(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Written beside the path and moved there, so that a lost job leaves the old split or none."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    # Null fields are written, too: a reader of one line has to see all fields.
    df.write.option("compression", "gzip").option("ignoreNullFields", "false").json(staged)
    fs, target = _fs(spark, path)
    fs.delete(target, True)
    if not fs.rename(_fs(spark, staged)[1], target):
        raise OSError(f"cannot move {staged} to {path}")


def prepared_split(spark: SparkSession, path: str, make: Callable[[], DataFrame], required: tuple[str, ...] = (), schema: str = PREPARED) -> tuple[DataFrame, str]:
    """(the split, `reused` or why it was made anew). The rows' order has to be a column: files have none."""
    why = fault(spark, path, required)
    if why:
        commit(spark, make(), path)
    return spark.read.schema(schema).json(path), why or "reused"
