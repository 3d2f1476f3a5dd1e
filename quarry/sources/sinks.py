"""Sinks: JSON, Parquet, gzipped packages, exports with metadata, stage caches and metric logs."""

from __future__ import annotations

import datetime
import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TOKENS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.operators.projections import require_package
from quarry.sources.fingerprints import content
from quarry.sources.readers import exists, read_stage, write_text

#: Export formats and the writer each uses. `hf_disk` has no Spark writer of its own and is a Parquet folder.
FORMATS = {"jsonl": ("json", ".jsonl"), "parquet": ("parquet", ".parquet"), "hf_disk": ("parquet", "")}
#: Splits that belong to the identifiers, not to an augmentation.
IDENTIFIER_SPLITS = ("tokens", "tokens_", "cluster_", "online_")


def write_split(df: DataFrame, folder: str, split: str, fmt: str = "jsonl", single_file: bool = False) -> str:
    """One folder for each split, committed as a whole. `single_file` is for small tables only: one task writes it."""
    if fmt.lower() not in FORMATS:
        raise ValueError(f"unknown export format {fmt!r}; known: {', '.join(FORMATS)}")
    writer, suffix = FORMATS[fmt.lower()]
    path = f"{folder}/{split}{suffix}"
    (df.coalesce(1) if single_file else df).write.mode("overwrite").format(writer).save(path)
    return path


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int = 0) -> DataFrame:
    """Rows in the order of `keys` over many files, and a manifest: file, n, low, high (its first and last key), before (rows of the
    files ahead). Sorted by ranges: no task sees all rows. `read_sorted` follows the manifest."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/rows")
    key = F.struct(*keys)
    written = spark.read.schema(df.schema).parquet(f"{path}/rows")
    files = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    earlier = Window.orderBy("low", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    manifest = files.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_sorted(spark: SparkSession, path: str, low: tuple | None = None, high: tuple | None = None, into: str = "place") -> DataFrame:
    """The rows that `write_sorted` wrote, each with its place in the order. Nothing is sorted: a row's place is its number in its file
    and the manifest's count of the rows ahead. Of files whose bounds lie outside low..high (keys, both ends included) none is read,
    but the files that are read are read whole."""
    manifest = spark.read.parquet(f"{path}/manifest")
    names = manifest.schema["low"].dataType.names
    bound = lambda values: F.struct(*[F.lit(v).cast(manifest.schema["low"].dataType[k].dataType).alias(k) for k, v in zip(names, values)])
    if low is not None:
        manifest = manifest.where(F.col("high") >= bound(low))
    if high is not None:
        manifest = manifest.where(F.col("low") <= bound(high))
    files = manifest.select("file", "before").collect()  # a row a file
    if not files:
        return spark.read.parquet(f"{path}/rows").where("false").withColumn(into, F.lit(None).cast("bigint"))
    rows = spark.read.parquet(*[f"{path}/rows/{r['file']}" for r in files])
    ahead = manifest.select(F.col("file").alias("_file"), "before")
    placed = rows.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_index"))
    joined = placed.join(F.broadcast(ahead), F.col("_name") == F.col("_file"))  # a row a file
    return joined.withColumn(into, F.col("before") + F.col("_index")).drop("_name", "_index", "_file", "before")


def split_metadata(df: DataFrame, path: str) -> dict:
    return {"rows": df.count(), "columns": df.columns, "features": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "data_file": path}


def export(corpora: dict[str, Corpus] | Corpus, folder: str, fmt: str = "jsonl", summary: dict | None = None, single_file: bool = False) -> None:
    """Every split of every split set, and a metadata.json for each set. A bare corpus is the set `default`."""
    for name, corpus in ({"default": corpora} if isinstance(corpora, Corpus) else corpora).items():
        target = f"{folder}/{name}"
        described, spark = {}, None
        for split in corpus:
            path = write_split(corpus[split], target, split, fmt, single_file)
            spark = corpus[split].sparkSession
            written = spark.read.format(FORMATS[fmt.lower()][0]).schema(corpus[split].schema).load(path)
            described[split] = split_metadata(written, path)
        if spark is None:
            continue
        meta = {"splits": described, "config": summary or {}}
        if TOKENS in corpus and "tokens" in corpus[TOKENS].columns:
            rows = corpus[TOKENS].selectExpr("max(base_vocab_size)", "sum(size(tokens))").first()
            meta["token_table"] = {"base_vocab_size": rows[0], "added": rows[1], "vocab_size": (rows[0] or 0) + (rows[1] or 0)}
        write_text(spark, f"{target}/metadata.json", json.dumps(meta, indent=2, ensure_ascii=False))


def write_package(corpus: Corpus, folder: str, metadata: dict | None = None, single_file: bool = False) -> None:
    """Exactly documents and both query splits as gzipped JSON, and metadata.json last."""
    require_package(corpus)
    counts, spark = {}, corpus[DOCUMENTS].sparkSession
    for split in (DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES):
        df = corpus[split].drop("_ord")
        (df.coalesce(1) if single_file else df).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{split}.jsonl.gz")
        counts[split] = spark.read.text(f"{folder}/{split}.jsonl.gz").count()
    write_text(spark, f"{folder}/metadata.json", json.dumps({**(metadata or {}), "rows": counts}, indent=2, ensure_ascii=False))


def stage_folder(root: str, stage: int, limit: int = 0) -> str:
    return f"{root}/stage_{stage}/{limit if limit > 0 else 'full'}"


def cached_stage(spark: SparkSession, path: str, make, required: tuple[str, ...] = ()) -> DataFrame:
    """The stage at this path, made and written if it is not there or lacks a required column."""
    found = read_stage(spark, path)
    if found is not None and set(required) <= set(found.columns):
        return found
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_key(version: str, plugin: str, params: dict, seed: int, split: str, inputs: dict[str, DataFrame]) -> str:
    """SHA-256 over what an augmentation's result depends on, in a stable form; of its inputs, over what they hold now."""
    body = {"version": version, "plugin": plugin, "params": params, "seed": seed, "split": split, "inputs": {k: content(v) for k, v in sorted(inputs.items())}}
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()


def cached_augmentation(root: str, key: str, corpus: Corpus, make) -> Corpus:
    """The augmented corpus of a key; splits that belong to the identifiers are always the current ones."""
    owned = lambda s: s == IDENTIFIER_SPLITS[0] or s.startswith(IDENTIFIER_SPLITS[1:])
    spark = next(iter(corpus.splits.values())).sparkSession
    folder = f"{root}/{key}"
    if not exists(spark, f"{folder}/complete.json"):
        made = {s: df for s, df in make(corpus).splits.items() if not owned(s)}
        for split, df in made.items():
            df.write.mode("overwrite").parquet(f"{folder}/{split}")
        write_text(spark, f"{folder}/complete.json", json.dumps(sorted(made)))
    names = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/complete.json").collect()))
    return Corpus({**{s: spark.read.parquet(f"{folder}/{s}") for s in names}, **{s: df for s, df in corpus.splits.items() if owned(s)}})


def json_safe(value):
    """Any value as JSON can hold it: numbers that are not finite become their names, unknown types their text."""
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def write_metrics(spark: SparkSession, metrics: dict, path: str | None = None) -> str:
    text = json.dumps(json_safe(metrics), indent=2, sort_keys=True)
    if path:
        write_text(spark, path, text)
    return text


def append_metrics(spark: SparkSession, metrics: dict, folder: str, job: str = "") -> None:
    """One more record in the append-only history; records are rows of text, so their fields may differ."""
    record = {"time": datetime.datetime.now(datetime.UTC).isoformat(), "job": job, **metrics}
    spark.createDataFrame([(json.dumps(json_safe(record)),)], "value string").coalesce(1).write.mode("append").text(f"{folder}/metrics_history.jsonl")
