"""Deduplication keys: a registry from a method's name to the column expression of its key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import h1_title, prefix, url_title
from quarry.functions.tokenizers import Tokenizer, encode_column, round_trip_column
from quarry.operators.subwords import Vocabulary, shown_text, with_ids

#: What a key is made from: names of the columns of a prepared question table.
URL, TEXT, DIGEST, NCI = "document_url", "document_text", "document_text_md5", "nci_dedup_title"
SHORT = 4000
#: Where `with_subwords` puts what keys of subwords are made from.
SUBWORDS = "_subwords"


def md5_key(value: Column, lowercase: bool = True) -> Column:
    return F.md5(F.lower(value) if lowercase else value)


def _text_digest(columns: list[str], lowercase: bool) -> Column:
    made = md5_key(F.col(TEXT), lowercase)
    return F.coalesce(F.col(DIGEST), made) if DIGEST in columns else made


def _tokens(columns: list[str], tokenizer: Tokenizer | None, lowercase: bool) -> Column:
    if isinstance(tokenizer, Vocabulary):
        return F.md5(F.array_join(F.slice(_prepared(columns), 1, 32).cast("array<string>"), ","))
    start = prefix(TEXT, 256)
    ids = encode_column(F.lower(start) if lowercase else start, tokenizer)
    return F.md5(F.array_join(F.slice(ids, 1, 32).cast("array<string>"), ","))


def _prepared(columns: list[str]) -> Column:
    if SUBWORDS not in columns:
        raise ValueError("keys of subwords need the column that `with_subwords` makes")
    return F.col(SUBWORDS)


def _round_trip(columns: list[str], text: Column, tokenizer: Tokenizer | None) -> Column:
    return shown_text(_prepared(columns)) if isinstance(tokenizer, Vocabulary) else round_trip_column(text, tokenizer)


def _nci_title(columns: list[str]) -> Column:
    """The prepared title if there is one, else the URL's for tables that have it, else the heading."""
    if NCI in columns:
        return F.col(NCI)
    return url_title(URL) if URL in columns else h1_title(TEXT)


#: name -> (columns of the table, tokenizer) -> key. The plain names ignore case, `url` included; `-cased` ones don't.
METHODS: dict[str, Callable[[list[str], Tokenizer | None], Column]] = {
    "url": lambda c, t: md5_key(F.col(URL)),
    "url-cased": lambda c, t: md5_key(F.col(URL), False),
    "title": lambda c, t: md5_key(url_title(URL)),
    "title-cased": lambda c, t: md5_key(url_title(URL), False),
    "h1": lambda c, t: md5_key(h1_title(TEXT)),
    "h1-cased": lambda c, t: md5_key(h1_title(TEXT), False),
    "text4k": lambda c, t: md5_key(prefix(TEXT, SHORT)),
    "text4k-cased": lambda c, t: md5_key(prefix(TEXT, SHORT), False),
    "full-text": lambda c, t: _text_digest(c, True),
    "full-text-cased": lambda c, t: _text_digest(c, False),
    "tokens-32": lambda c, t: _tokens(c, t, True),
    "tokens-32-cased": lambda c, t: _tokens(c, t, False),
    "ncititle": lambda c, t: F.md5(_round_trip(c, _nci_title(c), t)),
    "nci-h1": lambda c, t: F.md5(_round_trip(c, h1_title(TEXT), t)),
    "pageid": lambda c, t: F.coalesce(F.col("pageid").cast("string"), F.hex(F.xxhash64(url_title(URL)))),
}


def key_for(method: str, columns: list[str], tokenizer: Tokenizer | None = None) -> Column | None:
    """The key of a method; None for `none`, which groups nothing."""
    if method == "none":
        return None
    if method not in METHODS:
        raise ValueError(f"unknown deduplication method {method!r}; known: {', '.join([*METHODS, 'none'])}")
    return METHODS[method](columns, tokenizer)


def with_subwords(df: DataFrame, method: str, vocabulary: Vocabulary | None) -> DataFrame:
    """df and, if the method's key is made from subwords, the column that `key_for` reads: first ids, or words as their ids show them."""
    if vocabulary is None or method not in ("tokens-32", "tokens-32-cased", "ncititle", "nci-h1"):
        return df
    if method.startswith("tokens-32"):
        start = prefix(TEXT, 256)
        return with_ids(df, F.lower(start) if method == "tokens-32" else start, vocabulary, SUBWORDS)
    title = h1_title(TEXT) if method == "nci-h1" else _nci_title(df.columns)
    return with_ids(df, title, vocabulary, "_ids", SUBWORDS).drop("_ids")
