"""A corpus pipeline of five stages: toxic documents go, one of each near-duplicate group stays, contaminated documents go, personal
data is masked, and what remains is packed into sequences.

Each stage works on all that its predecessor kept; the last one's rows are the result. A stage takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, near_duplicates, packing, pii, toxicity
from quarry.llm.common import benchmark, documents, labels, materialise


#: Bytes of text that reach a Python worker at once, for all stages of a session: bounds what a batch takes on both sides.
BATCH_BYTES = 8 << 20
#: Rows that a table's reader decodes at once, and bytes of a written row group. A row is a whole text: 4096 of them, and row groups of
#: 128 MB, are arrays of tens of megabytes in every task, for which a heap grows and which it keeps.
READ_ROWS, ROW_GROUP_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Settings of the session, since a stage's rows are made when its caller writes them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    spark.conf.set("parquet.block.size", ROW_GROUP_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds toxic go; it is fitted on the labelled rows of docs that are not held out. A null text stays."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles and a similarity of 0.8 the document with the least id stays, in all its rows."""
    small_batches(spark)
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in windows of benchmark items go; one without words stays."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, benchmark(spark, sf_dir))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind's name; no document goes, and other columns stay as they are."""
    small_batches(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids; a null or empty text is its end id alone."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Trees, signatures and merges of a tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
