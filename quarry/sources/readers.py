"""Scans: question collections, ranking collections, qrels, packages, exports, token tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions.ordinals import ORD, with_dense_order
from quarry.operators.projections import preprocess_package, require_package

TRAIN, VALIDATION = "train", "validation"
#: How files name the splits.
SHORT = {TRAIN: "train", VALIDATION: "dev"}


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str, empty: bool = False) -> bool:
    """True for a file with content (or any file, if it may be empty) or a folder, wherever Spark can read it."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return False
    status = fs.getFileStatus(target)
    return empty or status.isDirectory() or status.getLen() > 0


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside the target and moved over it, so that readers see the old or the new file."""
    fs, target = _fs(spark, path)
    beside = target.suffix(".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"cannot move {beside} to {target}")


def with_line_order(df: DataFrame) -> DataFrame:
    """`_ord`: the place of each row in its file, as far as order matters: increasing in reading order, not dense."""
    return df.withColumn(ORD, F.monotonically_increasing_id())


def read_json(spark: SparkSession, path: str, schema: str, partitions: int = 0) -> DataFrame:
    """Newline-delimited JSON, plain or gzipped, under a declared schema, in file order.

    A gzipped file is one task; `partitions` deals its rows out right behind the scan.
    """
    rows = with_line_order(spark.read.schema(schema).json(path))
    return rows.repartition(partitions) if partitions and path.endswith(".gz") else rows


@dataclass(frozen=True)
class QuestionSource:
    """Where a split of a question collection may be, first choice first: a file in the wanted style, one in the default style, the full one."""

    folder: str
    style: str = "simplified"

    def candidates(self, split: str) -> list[tuple[str, str, str]]:
        """(path, schema, layout) in the order in which they are tried."""
        short = SHORT[split]
        out = []
        for gz in ("", ".gz"):
            out.append((f"{self.folder}/{short}-{self.style}.jsonl{gz}", schemas.PREPARED, "simple"))
        if self.style in ("simplified", "simplenorm", "title-abstract-content", "ncinorm"):
            out += [(f"{self.folder}/{short}-simplified.jsonl{gz}", schemas.QUESTIONS_SIMPLE, "simple") for gz in ("", ".gz")]
        out += [(f"{self.folder}/{short}-full.jsonl{gz}", schemas.QUESTIONS_FULL, "full") for gz in ("", ".gz")]
        out.append((f"{self.folder}/{short}-columnar.parquet", schemas.QUESTIONS_COLUMNAR, "columnar"))
        return out

    def read(self, spark: SparkSession, split: str) -> tuple[DataFrame, str]:
        for path, schema, layout in self.candidates(split):
            if exists(spark, path):
                df = with_line_order(spark.read.schema(schema).parquet(path)) if layout == "columnar" else read_json(spark, path, schema)
                return df, layout
        raise FileNotFoundError(f"no file for split {split!r} in {self.folder}; tried {[p for p, _, _ in self.candidates(split)]}")


GROUPINGS = ("url", "title", "h1", "text4k", "full-text", "tokens-32", "ncititle", "nci-h1", "pageid", "none")


def package_path(root: str, config: str) -> str:
    """Folder of a packaged corpus: `style-grouping` names data/<style>/<grouping>, a name with a slash is a path, none is the root."""
    if not config:
        return root
    if "/" in config:
        return f"{root}/{config}"
    name = config.replace("_", "-")
    for grouping in sorted(GROUPINGS, key=len, reverse=True):
        if name.endswith(f"-{grouping}"):
            return f"{root}/data/{name[: -len(grouping) - 1]}/{grouping}"
    raise ValueError(f"{config!r} ends with no known grouping: {', '.join(GROUPINGS)}")


def read_package(spark: SparkSession, root: str, config: str = "", text_limit: int = -1, lowercase: bool = False) -> Corpus:
    """The three gzipped files of a package; all of them and metadata.json have to be there."""
    folder = package_path(root, config)
    names = {s: f"{folder}/{s}.jsonl.gz" for s in (DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES)}
    if gone := [p for p in (*names.values(), f"{folder}/metadata.json") if not exists(spark, p)]:
        raise FileNotFoundError(f"a package needs {gone}")
    return require_package(preprocess_package(Corpus({s: read_json(spark, p, schemas.CANONICAL) for s, p in names.items()}), text_limit, lowercase))


def read_ranking(spark: SparkSession, root: str) -> Corpus:
    """documents, train and validation queries of a ranking collection, from its three JSON files."""
    folder = f"{root}/data"
    return Corpus({
        DOCUMENTS: read_json(spark, f"{folder}/documents.jsonl", schemas.RANKING_DOCUMENTS),
        TRAIN_QUERIES: read_json(spark, f"{folder}/train_queries.jsonl", schemas.RANKING_QUERIES),
        VALIDATION_QUERIES: read_json(spark, f"{folder}/validation_queries.jsonl", schemas.RANKING_QUERIES),
    })


def parse_query_lines(lines: DataFrame, order: str = ORD) -> DataFrame:
    """qid, query from lines `qid<TAB>query`: cut at the first tab, lines without one skipped, the last line of a qid wins."""
    parts = F.split("value", "\t", 2)
    rows = lines.where(F.trim("value") != "").select(parts.alias("p"), order).where(F.size("p") == 2).select(F.col("p")[0].alias("qid"), F.col("p")[1].alias("query"), order)
    return rows.groupBy("qid").agg(F.max_by("query", order).alias("query"))


def parse_judgement_lines(lines: DataFrame) -> DataFrame:
    """qid, docid, relevance from lines of at least four fields."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(parts.alias("p")).where(F.size("p") >= 4).select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("docid"), F.col("p")[3].cast("int").alias("relevance"))


def parse_document_lines(lines: DataFrame) -> DataFrame:
    """docid, url, title, body and malformed (fewer than four fields) of lines with four fields; further tabs belong to the body."""
    parts = F.split("value", "\t", 4)
    field = lambda k: F.get(F.col("p"), k)
    return lines.select(parts.alias("p")).select(field(0).alias("docid"), field(1).alias("url"), field(2).alias("title"), field(3).alias("body"), (F.size("p") < 4).alias("malformed"))


def active_documents(parsed: DataFrame, active: DataFrame, drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, accounting): well-formed rows of active docids, without blank bodies if wanted; one row of counts.

    written, malformed, inactive, empty, missing (active docids that no line has).
    """
    wanted = active.select(F.col("docid").alias("_a")).distinct()
    blank = F.lit(drop_empty) & (F.trim(F.coalesce("body", F.lit(""))) == "")
    state = F.when(F.col("malformed"), "malformed").when(F.col("_a").isNull(), "inactive").when(blank, "empty").otherwise("written")
    marked = parsed.join(wanted, parsed["docid"] == F.col("_a"), "left").withColumn("state", state)
    documents = marked.where("state = 'written'").select("docid", "url", "title", "body")
    counts = marked.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("written", "malformed", "inactive", "empty")])
    lost = active.select("docid").distinct().join(parsed.where("not malformed").select("docid"), "docid", "left_anti").agg(F.count("*").alias("missing"))
    return documents, counts.join(F.broadcast(lost))  # one row each


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return with_line_order(spark.read.text(path))


def nth_row(df: DataFrame, n: int, order: str = ORD) -> DataFrame:
    """The n-th row in order, from 0."""
    return df.orderBy(order).offset(n).limit(1)


def read_named(spark: SparkSession, path: str, fmt: str = "parquet", limit: int = 0, order: str | None = None) -> DataFrame:
    df = with_line_order(spark.read.format(fmt).load(path))
    return df.orderBy(order or ORD).limit(limit) if limit > 0 else df


def read_stage(spark: SparkSession, path: str) -> DataFrame | None:
    """A finished stage, None if it was never finished. A damaged one raises: it is not silently made anew."""
    return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS", empty=True) else None


def read_export(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "validation"), optional: tuple[str, ...] = ("validation_index",), most_eval: int = 0) -> Corpus:
    """Training rows of an export. At most `most_eval` rows, the first, of splits other than train."""
    found = {}
    for split in (*splits, *optional):
        path = f"{folder}/{split}.jsonl"
        if not exists(spark, path):
            if split in optional:
                continue
            raise FileNotFoundError(path)
        df = read_json(spark, path, schemas.TRAINING)
        found[split] = df.orderBy(ORD).limit(most_eval) if most_eval > 0 and split != "train" else df
    return Corpus(found)


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """token, position, base_vocab_size in file order, from rows with a list of tokens or with one each; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "token string, position long, base_vocab_size long")
    rows = read_json(spark, path, schemas.TOKEN_TABLE)
    return long_token_table(rows)


def long_token_table(rows: DataFrame) -> DataFrame:
    listed = rows.select(ORD, "base_vocab_size", F.coalesce("tokens", F.array("token")).alias("t"))
    each = listed.select(ORD, "base_vocab_size", F.posexplode("t").alias("_p", "token"))
    return with_dense_order(each, [ORD, "_p"], "position").select("token", "position", "base_vocab_size")


def read_token_init(spark: SparkSession, path: str) -> DataFrame:
    """token, payload; a missing field, an empty or non-numeric payload or a repeated token is an error."""
    rows = read_json(spark, path, schemas.TOKEN_INIT).drop(ORD)
    bad = rows.where("token is null or payload is null or size(payload) = 0 or exists(payload, x -> x is null)")
    if bad.take(1):
        raise ValueError(f"{path}: a row lacks its token or a payload of numbers")
    if again := rows.groupBy("token").count().where("count > 1").take(1):
        raise ValueError(f"{path}: token {again[0][0]!r} stands twice")
    return rows


def read_run_metadata(spark: SparkSession, folder: str) -> dict:
    path = f"{folder}/metadata.json"
    return json.loads(read_text(spark, path)) if exists(spark, path) else {}


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REVISIONS).json(path)
