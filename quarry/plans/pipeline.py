"""The corpus pipeline: a dataset with its split sets, then identifiers, augmentations, transformations and exports in any order."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TOKENS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions.keys import key_for, with_subwords
from quarry.functions.ordinals import ORD
from quarry.functions.text import url_parameter, url_title
from quarry.functions.tokenizers import BYTES, Tokenizer
from quarry.operators import grouping, identifiers, joins, projections, sampling, tokens
from quarry.operators import semantic as tree
from quarry.operators.subwords import Vocabulary
from quarry.plans import graph
from quarry.plans.plugins import Param, Registry
from quarry.sources import prepared, readers, sinks
from quarry.sources.fingerprints import Fingerprints
from quarry.schemas import PREPARED

REGISTRY = Registry()


@dataclass(frozen=True)
class Step:
    plugin: str
    params: dict[str, Any] = field(default_factory=dict)


#: Sections that hold steps, in their usual order, and the kind of plugin that each names.
SECTIONS = {"dataset": "dataset", "identifier": "identifier", "augmentations": "augmentation", "transformations": "transformation", "export": "export"}
DEFAULTS = {
    "identifier": (Step("identity"),),
    "augmentations": (Step("validation_index"),),
    "transformations": (Step("tokenizer"), Step("task_prefix_tokens"), Step("multitask"), Step("drop_columns")),
    "export": (),
}


def _steps(section: str, value: Any) -> tuple[Step, ...]:
    """A section is a name, a mapping of names to parameters in their order, or a list of both; `none` is no step."""
    if value in (None, "none"):
        return ()
    if isinstance(value, str):
        return (Step(value),)
    if isinstance(value, list):
        return tuple(s for v in value for s in _steps(section, v))
    if not isinstance(value, dict):
        raise ValueError(f"section {section!r} holds names with their parameters, not {value!r}")
    for name, params in value.items():
        if params is not None and not isinstance(params, dict):
            raise ValueError(f"{section} {name!r}: parameters are a mapping, not {params!r}")
    return tuple(Step(name, dict(params or {})) for name, params in value.items() if name != "none")


@dataclass(frozen=True)
class PipelineConfig:
    """The steps of a run in the order in which they run, and what holds for all of them."""

    steps: tuple[tuple[str, Step], ...]
    split_sets: tuple[sampling.SplitSpec, ...] = (sampling.SplitSpec("full", -1, -1),)
    seed: int = 42
    dataset_limit: int = 0
    cache_dir: str = ""

    @classmethod
    def from_dict(cls, config: dict[str, Any]) -> PipelineConfig:
        """From plain values, as a JSON file holds them. Sections run in the order of the mapping; one that is not named runs with its
        defaults behind those that usually come before it."""
        settings = set(cls.__dataclass_fields__) - {"steps"}
        if unknown := sorted(set(config) - settings - set(SECTIONS)):
            raise ValueError(f"unknown sections {unknown}; known: {sorted(settings | set(SECTIONS))}")
        order = [s for s in config if s in SECTIONS]
        usual = list(SECTIONS)
        for section in usual:
            if section not in order:
                before = [order.index(s) for s in usual[: usual.index(section)] if s in order]
                order.insert(max(before, default=-1) + 1, section)
        steps = tuple((SECTIONS[s], step) for s in order for step in (_steps(s, config[s]) if s in config else DEFAULTS.get(s, ())))
        if [k for k, _ in steps].count("dataset") != 1 or steps[0][0] != "dataset":
            raise ValueError("a pipeline begins with its one dataset")
        sets = tuple(sampling.SplitSpec(**s) for s in config.get("split_sets", [])) or cls.__dataclass_fields__["split_sets"].default
        return cls(steps, sets, int(config.get("seed", 42)), int(config.get("dataset_limit", 0)), str(config.get("cache_dir", "")))

    def digest(self) -> str:
        return hashlib.sha1(json.dumps(self, default=lambda o: o.__dict__, sort_keys=True).encode()).hexdigest()


def compose(config: dict[str, Any], overrides: list[str]) -> dict[str, Any]:
    """The configuration with `a.b.c=value` overrides; values are JSON where they can be read as such."""
    out = json.loads(json.dumps(config))
    for item in overrides:
        path, _, text = item.partition("=")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        at = out
        *parents, last = path.split(".")
        for name in parents:
            at = at.setdefault(name, {})
        at[last] = value
    return out


class Runner:
    """Runs a configuration; with a `cache_dir` each step's result is kept there, and only what has changed runs again."""

    def __init__(self, spark: SparkSession, config: PipelineConfig, registry: Registry = REGISTRY) -> None:
        self.spark, self.config, self.report = spark, config, graph.Report()
        plugins = [(registry.get(kind, step.plugin), step) for kind, step in config.steps]
        nodes = [graph.Node(plugin, plugin.resolve(step.params)) for plugin, step in plugins]
        settings = {"split_sets": [s.__dict__ for s in config.split_sets], "dataset_limit": config.dataset_limit}
        self.store = graph.Store(spark, config.cache_dir) if config.cache_dir else None
        known = Fingerprints(spark, config.cache_dir) if config.cache_dir else None
        self.nodes = graph.with_digests(nodes, config.seed, settings, known)

    def _call(self, node: graph.Node, state: dict[str, Corpus] | None) -> dict[str, Corpus]:
        run, config = node.plugin.run, self.config
        if node.plugin.kind == "dataset":
            corpus = run(self.spark, **node.params)
            if not isinstance(corpus, Corpus):
                raise TypeError(f"{node.name} returned {type(corpus).__name__}, no corpus")
            return sampling.split_sets(joins.limit_corpus(corpus, config.dataset_limit), list(config.split_sets), config.seed, ORD)
        if node.plugin.kind == "export":
            run(state, {"digest": config.digest()}, **node.params)
            return state
        out = {}
        for name, one in state.items():
            if node.plugin.kind == "identifier":
                mapping, extra = run(one[DOCUMENTS], config.seed, **node.params)
                out[name] = joins.assign_identifiers(one, mapping, extra=extra)
            elif node.plugin.kind == "augmentation":
                out[name] = run(one, config.seed, **node.params)
            else:
                out[name] = run(one, **node.params)
        return out

    def run(self) -> dict[str, Corpus]:
        out, self.report = graph.run(self.spark, self.nodes, self._call, self.store)
        return out


def run(spark: SparkSession, config: PipelineConfig, registry: Registry = REGISTRY) -> dict[str, Corpus]:
    """One corpus for each split set. Without a cache lazy, but for counts that a step needs to check, and for an export."""
    return Runner(spark, config, registry).run()


# --- built-in plugins

_SOURCE = Param("data_source", "str", help="folder that holds the collection", source=True)
_VOCABULARY = Param("vocabulary", "str", "", help="file of subwords, one in a line, for keys made from them", source=True)
_LOWER = Param("lowercase", "bool", True)


def _vocabulary(spark: SparkSession, path: str) -> Vocabulary | None:
    return Vocabulary.read(spark, path) if path else None


@REGISTRY.plugin(
    "dataset", "questions", _SOURCE, Param("text_style", "str", "simplenorm"), Param("text_limit", "int", 4000), Param("dedup_method", "str", "url"), _LOWER, _VOCABULARY,
    Param("revisions", "str", "", help="file of page ids by revision, for the key `pageid`", source=True), Param("prepared_cache", "bool", False, help="keep prepared splits beside the collection"),
)
def questions(spark: SparkSession, data_source: str, text_style: str, text_limit: int, dedup_method: str, lowercase: bool, vocabulary: str, revisions: str, prepared_cache: bool) -> Corpus:
    """A question collection: both splits prepared, grouped under a key with validation first, and laid out."""
    parts = {}
    for split in (readers.TRAIN, readers.VALIDATION):
        if prepared_cache:
            needed = ("nci_dedup_title",) if dedup_method == "ncititle" else ()
            path = f"{data_source}/{readers.SHORT[split]}-{text_style}.prepared.jsonl.gz"
            df, _ = prepared.prepared_split(spark, path, lambda: _prepared_question_split(spark, data_source, text_style, split), (ORD, *needed), f"{PREPARED}, {ORD} BIGINT")
        else:
            df = _prepared_question_split(spark, data_source, text_style, split)
        parts[split] = df.withColumn("split", F.lit(split))
    if dedup_method == "pageid":
        pages = readers.read_revisions(spark, revisions) if revisions else None
        parts = {s: joins.with_page_ids(df, pages, url_parameter("document_url", "oldid"), url_title("document_url")) if pages is not None else df for s, df in parts.items()}
    return question_corpus(parts["train"], parts["validation"], dedup_method, text_limit, lowercase, _vocabulary(spark, vocabulary))


def _prepared_question_split(spark: SparkSession, data_source: str, text_style: str, split: str) -> DataFrame:
    """The first source of a split that is there, in the wanted style, with its titles."""
    df, layout = readers.QuestionSource(data_source, text_style).read(spark, split)
    if layout == "columnar":
        df, layout = projections.columnar_questions(df).withColumn(ORD, F.col("example_id")), "full"
    if layout == "full":
        df = projections.simplify_questions(df)
    if "document_normalization" in df.columns:
        return df
    titled = projections.add_titles(projections.drop_answers(df), "simplified" if layout == "simple" else "full", split)
    return projections.apply_style(titled, text_style, split, layout)


def question_corpus(train: DataFrame, validation: DataFrame, method: str, limit: int | None, lowercase: bool, vocabulary: Vocabulary | None = None) -> Corpus:
    """documents and queries of prepared question tables (split, _ord, example_id, question_text, document_text, document_url)."""
    both = with_subwords(train.unionByName(validation, allowMissingColumns=True), method, vocabulary)
    document = projections.question_document("document_text", "document_url", "example_id", limit, lowercase)
    query = projections.question_query("question_text", "example_id")
    key = key_for(method, both.columns, vocabulary)
    if key is None:
        one, two = grouping.number_without_grouping(train, validation, [ORD])
        numbered = one.unionByName(two, allowMissingColumns=True)
        documents, queries = numbered.select("docid", *document, ORD), numbered
    else:
        order = grouping.split_order(F.col("split"), F.col(ORD))
        groups, queries = grouping.group_by_key(both.withColumn("_in", F.col(ORD)), key, order, F.col("example_id"), ["document_text", "document_url"], sources=True)
        documents = groups.select("docid", *[c for c in projections.question_document("document_text", "document_url", F.lit(""), limit, lowercase)][:3], "source_ids", F.col("docid").cast("bigint").alias(ORD))
        queries = queries.withColumnRenamed("_in", ORD)
    splits = {DOCUMENTS: documents}
    for name, split in ((TRAIN_QUERIES, "train"), (VALIDATION_QUERIES, "validation")):
        splits[name] = queries.where(F.col("split") == split).select("docid", *query, ORD)
    return Corpus(splits)


@REGISTRY.plugin("dataset", "ranking_documents", _SOURCE, _LOWER, Param("text_style", "str", "content"))
def ranking_documents(spark: SparkSession, data_source: str, lowercase: bool, text_style: str) -> Corpus:
    corpus = readers.read_ranking(spark, data_source)
    documents = corpus[DOCUMENTS].select("docid", F.lit("document").alias("kind"), *projections.ranking_document("title", "body", text_style, None, lowercase), ORD)
    queries = {s: corpus[s].select("docid", F.lit("query").alias("kind"), projections.ranking_query("text", lowercase), F.lit("").alias("title"), ORD) for s in (TRAIN_QUERIES, VALIDATION_QUERIES)}
    return Corpus({DOCUMENTS: documents, **queries})


@REGISTRY.plugin("dataset", "package", _SOURCE, Param("config_name", "str", ""), Param("text_limit", "int", -1), Param("lowercase", "bool", False))
def package(spark: SparkSession, data_source: str, config_name: str, text_limit: int, lowercase: bool) -> Corpus:
    return readers.read_package(spark, data_source, config_name, text_limit, lowercase)


@REGISTRY.plugin("identifier", "identity")
def identity(documents: DataFrame, seed: int) -> tuple[DataFrame, dict]:
    return identifiers.identity_ids(documents), {}


@REGISTRY.plugin("identifier", "atomic", Param("prefix", "str", "doc"), Param("start", "int", 0), Param("base_vocab_size", "int", BYTES.vocab_size))
def atomic(documents: DataFrame, seed: int, prefix: str, start: int, base_vocab_size: int) -> tuple[DataFrame, dict]:
    mapping = identifiers.atomic_ids(documents, prefix, start)
    return mapping, {TOKENS: identifiers.token_table(mapping, base_vocab_size)}


@REGISTRY.plugin("identifier", "naive", Param("budget", "int", 320_000), Param("budget_multiplier", "float", 0.0), Param("pad_to_max_length", "bool", False), Param("exact", "bool", False))
def naive(documents: DataFrame, seed: int, budget: int, budget_multiplier: float, pad_to_max_length: bool, exact: bool) -> tuple[DataFrame, dict]:
    return identifiers.naive_ids(documents, budget, budget_multiplier, pad_to_max_length, seed, exact), {}


@REGISTRY.plugin("identifier", "uuid4", Param("output", "str", "hex", ("hex", "int")), Param("exact", "bool", False))
def uuid4(documents: DataFrame, seed: int, output: str, exact: bool) -> tuple[DataFrame, dict]:
    return identifiers.uuid4_ids(documents, output, seed, exact), {}


@REGISTRY.plugin("identifier", "hash_baseN", Param("length", "int", 4), Param("alphabet", "str", "base64_urlsafe"), Param("custom_alphabet", "str", ""), Param("salt_start", "int", 0))
def hash_base_n(documents: DataFrame, seed: int, length: int, alphabet: str, custom_alphabet: str, salt_start: int) -> tuple[DataFrame, dict]:
    return identifiers.hash_ids(documents, length, alphabet, custom_alphabet, salt_start), {}


@REGISTRY.plugin(
    "identifier", "semantic", Param("vectors", "str", "vector"), Param("branching_factor", "int", 10), Param("max_leaf_size", "int", 100),
    Param("normalize_embeddings", "bool", True), Param("kmeans_max_iter", "int", 100), Param("kmeans_n_init", "int", 4),
)
def semantic(documents: DataFrame, seed: int, vectors: str, branching_factor: int, max_leaf_size: int, normalize_embeddings: bool, kmeans_max_iter: int, kmeans_n_init: int) -> tuple[DataFrame, dict]:
    """Documents bring their vectors in a column; how they were made is not this engine's business."""
    rows = documents.select("docid", ORD, F.col(vectors).alias("vector"))
    return tree.semantic_ids(rows, branching_factor, max_leaf_size, seed, kmeans_n_init, kmeans_max_iter, normalize_embeddings), {}


@REGISTRY.plugin("augmentation", "validation_index", Param("output_split_name", "str", "validation_index"))
def validation_index(corpus: Corpus, seed: int, output_split_name: str) -> Corpus:
    return corpus.merge(extra={output_split_name: joins.validation_index(corpus)})


@REGISTRY.plugin("augmentation", "titles", _LOWER)
def titles(corpus: Corpus, seed: int, lowercase: bool) -> Corpus:
    return corpus.merge(extra={"titles": projections.titles_split(corpus[DOCUMENTS], lowercase)})


_TOKENIZER = Param("tokenizer_name", "str", "", help="file of subwords, one in a line; none: bytes", source=True)
_MARKS = (Param("unknown", "str", "[UNK]"), Param("end", "str", "[SEP]"), Param("continuation", "str", "##"), Param("word_end", "str", ""))


def _tokenizer(corpus: Corpus, path: str, **marks: str) -> Tokenizer:
    return Vocabulary.read(next(iter(corpus.splits.values())).sparkSession, path, **marks) if path else BYTES


@REGISTRY.plugin(
    "transformation", "tokenizer", _TOKENIZER, *_MARKS, Param("document_max_length", "int", 32), Param("query_max_length", "int", 128),
    Param("rewrite_text_from_text_tokens", "bool", False), Param("drop_text_after_tokenization", "bool", True),
)
def tokenizer(
    corpus: Corpus, tokenizer_name: str, document_max_length: int, query_max_length: int, rewrite_text_from_text_tokens: bool, drop_text_after_tokenization: bool, **marks: str
) -> Corpus:
    added = joins.added_token_ids(corpus[TOKENS]) if TOKENS in corpus else None
    how = _tokenizer(corpus, tokenizer_name, **marks)
    return tokens.tokenise(corpus, how, document_max_length, query_max_length, added, None, rewrite_text_from_text_tokens, drop_text_after_tokenization)


@REGISTRY.plugin("transformation", "task_prefix_tokens", _TOKENIZER, *_MARKS)
def task_prefix_tokens(corpus: Corpus, tokenizer_name: str, **marks: str) -> Corpus:
    return tokens.task_prefixes(corpus, _tokenizer(corpus, tokenizer_name, **marks))


@REGISTRY.plugin(
    "transformation", "multitask", Param("train_output_split", "str", "train"), Param("validation_output_split", "str", "validation"), Param("shuffle_train", "bool", False),
    Param("shuffle_validation", "bool", False), Param("shuffle_seed", "int", 42), Param("document_row_multiplier", "int", 1),
)
def multitask(corpus: Corpus, train_output_split: str, validation_output_split: str, shuffle_train: bool, shuffle_validation: bool, shuffle_seed: int, document_row_multiplier: int) -> Corpus:
    return tokens.multitask(corpus, train_output_split, validation_output_split, shuffle_train, shuffle_validation, shuffle_seed, document_row_multiplier)


@REGISTRY.plugin("transformation", "drop_columns", Param("columns", "list", []), Param("splits", "list", []), Param("ignore_missing", "bool", True))
def drop_columns(corpus: Corpus, columns: list, splits: list, ignore_missing: bool) -> Corpus:
    return projections.drop_columns(corpus, columns, splits, ignore_missing)


@REGISTRY.plugin("export", "disk_writer", Param("path", "str"), Param("format", "str", "jsonl", ("jsonl", "parquet", "hf_disk")))
def disk_writer(corpora: dict[str, Corpus], summary: dict, path: str, format: str) -> None:
    sinks.export(corpora, path, format, summary)


@REGISTRY.plugin("export", "package", Param("path", "str"), Param("text_style", "str", ""), Param("dedup_method", "str", ""))
def package_export(corpora: dict[str, Corpus], summary: dict, path: str, text_style: str, dedup_method: str) -> None:
    for name, corpus in corpora.items():
        sinks.write_package(corpus, f"{path}/{name}", {**summary, "text_style": text_style, "dedup_method": dedup_method})
