"""The registered queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, fill_in_middle, html_text, language_id, line_dedup, lm_scoring, media, near_duplicates, oracles, packing, pii, quality, toxicity, vector_codes
from quarry.llm.common import benchmark, documents, embeddings, labels, pages


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.learn(docs))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group(documents(spark, sf_dir), words=4)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.learn(docs, labels(spark, sf_dir)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, labels(spark, sf_dir)))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("text_key")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(pages(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.drop_repeated(documents(spark, sf_dir)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_text": op9_html_text,
    "op10_media": op10_media,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op2_near_duplicates": oracles.NEAR_DUPLICATES,
    "op8_decontaminate": oracles.DECONTAMINATION,
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "op12_line_dedup": oracles.LINE_DEDUP,
    "op13_vector_codes": oracles.VECTOR_CODES,
}
