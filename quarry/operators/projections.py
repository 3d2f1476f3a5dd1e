"""Row layouts, column selection, enrichment, conversion of layouts, and checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions.styles import FULL_ONLY, style_column
from quarry.functions.text import h1_title, join_filled, prefix, strip_to_text, trim_white, url_title


def question_document(text: Column | str, url: Column | str, source: Column | str, limit: int | None = None, lowercase: bool = True) -> list[Column]:
    """kind, text, title, source_ids of a document: the text is cut first, then lower-cased; the title is the URL's."""
    cut = prefix(text, limit)
    source = F.col(source) if isinstance(source, str) else source
    return [F.lit("document").alias("kind"), (F.lower(cut) if lowercase else cut).alias("text"), url_title(url).alias("title"), F.array(source.cast("string")).alias("source_ids")]


def question_query(text: Column | str, source: Column | str) -> list[Column]:
    """kind, text, title, source_ids of a query: its text stays as it is."""
    text, source = (F.col(c) if isinstance(c, str) else c for c in (text, source))
    return [F.lit("query").alias("kind"), text.alias("text"), F.lit("").alias("title"), F.array(source.cast("string")).alias("source_ids")]


def ranking_document(title: str, body: str, style: str = "content", limit: int | None = None, lowercase: bool = True) -> list[Column]:
    """text and title of a ranking document; the limit cuts the body before anything else, the title is lower-cased on its own."""
    low = (lambda c: F.lower(c)) if lowercase else (lambda c: c)
    main = strip_to_text(low(prefix(F.coalesce(F.col(body), F.lit("")), limit)))
    head = low(strip_to_text(title))
    if style not in ("content", "title-content"):
        raise ValueError(f"unknown text style {style!r}; known: content, title-content")
    return [(main if style == "content" else join_filled(head, main)).alias("text"), head.alias("title")]


def ranking_query(text: str, lowercase: bool = True) -> Column:
    return (F.lower(text) if lowercase else F.col(text)).alias("text")


def preprocess_package(corpus: Corpus, limit: int = -1, lowercase: bool = False) -> Corpus:
    """Cut and lower-case the texts of the documents only."""
    if limit <= 0 and not lowercase:
        return corpus
    cut = prefix("text", limit if limit > 0 else None)
    return corpus.replace(**{DOCUMENTS: corpus[DOCUMENTS].withColumn("text", F.lower(cut) if lowercase else cut)})


ANSWERS = ("long_answer_candidates", "annotations")
MARKUP = ("document_html", "document_tokens", "question_tokens")


def drop_answers(df: DataFrame) -> DataFrame:
    return df.drop(*ANSWERS)


def drop_columns(corpus: Corpus, columns: str | Iterable[str], splits: str | Iterable[str] = (), ignore_missing: bool = True) -> Corpus:
    """Without the columns in the named splits (all, if none are named). Strictly, a missing split or column is an error."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    chosen = [splits] if isinstance(splits, str) else list(splits)
    if not columns:
        return corpus
    chosen = chosen or list(corpus)
    if not ignore_missing:
        if gone := sorted(set(chosen) - set(corpus)):
            raise ValueError(f"missing splits: {gone}")
        for name in chosen:
            require_columns(name, corpus[name], columns)
    return corpus.map(lambda name, df: df.drop(*columns) if name in chosen else df)


def rename_token_columns(corpus: Corpus) -> Corpus:
    """text_tokens to input_ids, docid_tokens to labels; an existing target is an error."""
    names = {"text_tokens": "input_ids", "docid_tokens": "labels"}

    def rename(split: str, df: DataFrame) -> DataFrame:
        if clash := [new for old, new in names.items() if old in df.columns and new in df.columns]:
            raise ValueError(f"split {split!r} has already the columns {clash}")
        return df.withColumnsRenamed(names)

    return corpus.map(rename)


def add_titles(df: DataFrame, source: str, split: str, text: str = "document_text", url: str = "document_url") -> DataFrame:
    """source, document_url_title, document_h1_title, document_nq_title, nci_dedup_title."""
    of_url, heading = url_title(url), h1_title(text)
    own = F.coalesce(F.nullif(F.col("document_title"), F.lit("")), of_url) if "document_title" in df.columns else of_url
    return df.withColumns({
        "source": F.lit(source), "document_url_title": of_url, "document_h1_title": heading, "document_nq_title": own,
        "nci_dedup_title": heading if split == "train" else own,
    })


def apply_style(df: DataFrame, style: str, split: str, layout: str) -> DataFrame:
    """The document text in a style, and which style it is. A simplified table cannot give a style that needs markup."""
    if style in FULL_ONLY and layout == "simple":
        raise ValueError(f"style {style!r} needs the full layout")
    styled = df.withColumn("document_text", style_column(style, split)).withColumn("document_normalization", F.lit(style))
    return styled.drop(*MARKUP)


def simplify_questions(df: DataFrame) -> DataFrame:
    """Full layout to simple layout: tokens joined by spaces, blanks inside a token as underscores, byte offsets dropped.

    Raises if the number of words is not the number of tokens.
    """
    words = F.transform("document_tokens", lambda t: F.replace(t["token"], F.lit(" "), F.lit("_")))
    text = F.array_join(words, " ")
    checked = F.when((F.size("document_tokens") == 0) | (F.size(F.split(text, " ")) == F.size("document_tokens")), text).otherwise(
        F.raise_error(F.lit("the simplified text has another number of tokens")).cast("string")
    )
    return df.withColumn("document_text", checked)


def columnar_questions(df: DataFrame) -> DataFrame:
    """The layout of structs of lists as the full layout of lists of structs."""
    tokens = F.transform(
        F.arrays_zip("document.tokens.start_byte", "document.tokens.end_byte", "document.tokens.is_html", "document.tokens.token"),
        lambda t: F.struct(t["start_byte"].alias("start_byte"), t["end_byte"].alias("end_byte"), t["is_html"].alias("html_token"), t["token"].alias("token")),
    )
    candidates = F.transform(
        F.arrays_zip("long_answer_candidates.start_token", "long_answer_candidates.end_token", "long_answer_candidates.top_level"),
        lambda c: F.struct(c["start_token"].alias("start_token"), c["end_token"].alias("end_token"), c["top_level"].alias("top_level")),
    )
    spans = lambda s: F.transform(F.arrays_zip(s["start_token"], s["end_token"]), lambda p: F.struct(p["start_token"].alias("start_token"), p["end_token"].alias("end_token")))
    notes = F.transform(
        F.arrays_zip("annotations.id", "annotations.long_answer", "annotations.short_answers", "annotations.yes_no_answer"),
        lambda a: F.struct(
            a["id"].cast("decimal(20,0)").alias("annotation_id"),
            F.struct(a["long_answer"]["candidate_index"].alias("candidate_index"), a["long_answer"]["start_token"].alias("start_token"), a["long_answer"]["end_token"].alias("end_token")).alias("long_answer"),
            spans(a["short_answers"]).alias("short_answers"),
            F.when(a["yes_no_answer"] == 0, "NO").when(a["yes_no_answer"] == 1, "YES").otherwise("NONE").alias("yes_no_answer"),
        ),
    )
    return df.select(
        F.col("id").cast("bigint").alias("example_id"), F.col("question.text").alias("question_text"), F.col("document.url").alias("document_url"),
        F.col("document.title").alias("document_title"), F.col("document.html").alias("document_html"), tokens.alias("document_tokens"),
        candidates.alias("long_answer_candidates"), notes.alias("annotations"),
    )


def titles_split(documents: DataFrame, lowercase: bool = True) -> DataFrame:
    """docid and text = cleaned title of every document that has one. Documents without any title give a typed empty table."""
    from quarry.functions.text import clean_title

    return documents.select("docid", clean_title("title", lowercase).alias("text")).where("text <> ''")


def only_queries(df: DataFrame) -> DataFrame:
    return df.where(F.col("kind") == "query")


def truncate_query_ids(ids: Column | str, kind: Column | str | None, n: int, eos: int | None) -> Column:
    """At most n content ids of a query, the end id kept if it was there; rows of other kinds and n <= 0 stay as they are."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    kind = F.lit("query") if kind is None else F.coalesce(F.col(kind) if isinstance(kind, str) else kind, F.lit("query"))
    if n <= 0:
        return ids
    ended = F.coalesce(F.try_element_at(ids, F.lit(-1)) == F.lit(eos), F.lit(False)) if eos is not None else F.lit(False)
    content = F.size(ids) - F.when(ended, 1).otherwise(0)
    end = F.when(ended, F.array(F.lit(eos).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when((kind == "query") & (content > n), F.concat(F.slice(ids, 1, n), end)).otherwise(ids)


def require_columns(split: str, df: DataFrame, columns: Iterable[str]) -> None:
    if gone := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"split {split!r} lacks the columns {gone}")


def require_package(corpus: Corpus) -> Corpus:
    if gone := sorted({DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES} - set(corpus)):
        raise ValueError(f"missing splits: {gone}")
    return corpus


def style_mismatches(df: DataFrame, style: str) -> DataFrame:
    """The styles in a table other than the wanted one; no row means that it is consistent."""
    return df.select("document_normalization").where(~F.col("document_normalization").eqNullSafe(F.lit(style))).distinct()


def url_and_body_titles(df: DataFrame, start: str, end: str, html: str = "html") -> Column:
    """The text between a pair of tags, white space trimmed; for raw pages."""
    return trim_white(F.regexp_extract(F.col(html), f"(?s)\\Q{start}\\E(.*?)\\Q{end}\\E", 1))
