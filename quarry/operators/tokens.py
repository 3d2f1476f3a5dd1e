"""Token columns and training layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions.ordinals import shuffle_key
from quarry.functions.tokenizers import BYTES, ByteTokenizer, Tokenizer, decode_column, encode_column
from quarry.operators.projections import rename_token_columns
from quarry.operators.sampling import repeat_rows
from quarry.operators.subwords import Vocabulary, with_ids, with_text

PREFIXES = {"document": "index:", "query": "query:"}


def ensure_eos(ids: Column, eos: int | None) -> Column:
    if eos is None:
        raise ValueError("the tokenizer has no end id")
    ended = F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False))
    return F.when(ended, ids).otherwise(F.concat(ids, F.array(F.lit(eos).cast("int"))))


def text_tokens(text: Column, kind: Column, tokenizer: Tokenizer | None = None, document_max: int = 32, query_max: int = 128, existing: Column | None = None) -> Column:
    """Ids with an end id: documents cut to their limit, queries beyond theirs an error; limits do not count the end id.

    Existing non-empty lists are kept and only closed.
    """
    tokenizer = tokenizer or BYTES
    given = F.coalesce(text, F.lit(""))
    ids = encode_column(given, tokenizer)
    if not isinstance(tokenizer, ByteTokenizer):
        return _limited(ids, ids, F.size(ids), text, kind, document_max, query_max, existing, tokenizer.eos_id)
    # Every character is a byte at least, so of a document no more characters than ids need to be encoded.
    start = encode_column(F.substring(given, 1, document_max), tokenizer)
    return _limited(ids, start, F.octet_length(given), text, kind, document_max, query_max, existing, tokenizer.eos_id)


def _limited(ids: Column, start: Column, n: Column, text: Column, kind: Column, document_max: int, query_max: int, existing: Column | None, eos: int | None) -> Column:
    """n: how many ids there are."""
    too_long = F.raise_error(F.concat(F.lit(f"a query has more than {query_max} tokens: "), F.coalesce(text, F.lit("")))).cast("array<int>")
    cut = F.when(kind == "document", F.slice(start, 1, document_max)).when(n > query_max, too_long).otherwise(ids)
    if existing is not None:
        cut = F.when(F.size(F.coalesce(existing, F.array().cast("array<int>"))) > 0, existing).otherwise(cut)
    return ensure_eos(cut, eos)


def docid_tokens(df: DataFrame, tokenizer: Tokenizer | None = None, added: DataFrame | None = None, single_chars: dict[str, int] | None = None,
                 ids: Column | None = None) -> DataFrame:
    """df and docid_tokens: one id for an added token; else an id for each character of a vocabulary, or the docid encoded.

    With single_chars, a character without an id is an error when the rows are read.
    """
    tokenizer = tokenizer or BYTES
    docid = F.col("docid")
    if ids is not None:
        pass
    elif single_chars is not None:
        table = F.create_map(*[x for k, v in single_chars.items() for x in (F.lit(k), F.lit(v))])
        chars = F.filter(F.split(docid, ""), lambda c: c != "")
        one = lambda c: F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("no single token for: "), c)).cast("int"))
        ids = F.transform(chars, one)
    elif isinstance(tokenizer, Vocabulary):
        df = with_ids(df, "docid", tokenizer, "_docid_ids")
        return docid_tokens(df, tokenizer, added, None, F.col("_docid_ids")).drop("_docid_ids")
    else:
        ids = encode_column(docid, tokenizer)
    if added is None:
        return df.withColumn("docid_tokens", ensure_eos(ids, tokenizer.eos_id))
    known = added.select(F.col("token").alias("_token"), F.col("token_id").alias("_token_id"))
    joined = df.join(known, docid == F.col("_token"), "left")
    own = F.when(F.col("_token_id").isNotNull(), F.array(F.col("_token_id").cast("int"))).otherwise(ids)
    return joined.withColumn("docid_tokens", ensure_eos(own, tokenizer.eos_id)).drop("_token", "_token_id")


def tokenise(corpus: Corpus, tokenizer: Tokenizer | None = None, document_max: int = 32, query_max: int = 128, added: DataFrame | None = None,
             single_chars: dict[str, int] | None = None, rewrite_text: bool = False, drop_text: bool = True) -> Corpus:
    """text_tokens and docid_tokens for every split with text and docid. A split without kind is documents or queries by its name."""

    def one(name: str, df: DataFrame) -> DataFrame:
        if not {"text", "docid"} <= set(df.columns):
            return df
        kind = F.col("kind") if "kind" in df.columns else F.lit("document" if name == DOCUMENTS else "query")
        existing = F.col("text_tokens") if "text_tokens" in df.columns else None
        if isinstance(tokenizer, Vocabulary):
            # A word has an id at least, so no more words than ids, and one too many of a query, need to be encoded.
            df = with_ids(df, "text", tokenizer, "_ids", most=max(document_max, query_max + 1))
            made = _limited(F.col("_ids"), F.col("_ids"), F.size("_ids"), F.col("text"), kind, document_max, query_max, existing, tokenizer.eos_id)
            df = df.withColumn("text_tokens", made).drop("_ids")
        else:
            df = df.withColumn("text_tokens", text_tokens(F.col("text"), kind, tokenizer, document_max, query_max, existing))
        out = docid_tokens(df, tokenizer, added, single_chars)
        if rewrite_text and isinstance(tokenizer, Vocabulary):
            return with_text(out, "text_tokens", tokenizer)
        if rewrite_text:
            return out.withColumn("text", decode_column(F.col("text_tokens"), tokenizer))
        return out.drop("text") if drop_text else out

    return corpus.map(one)


def add_task_prefix(ids: Column, kind: Column, tokenizer: Tokenizer | None = None, prefixes: dict[str, str] | None = None) -> Column:
    """The prefix ids of the row's kind in front, one end id behind; rows of other kinds stay."""
    tokenizer = tokenizer or BYTES
    eos = F.lit(tokenizer.eos_id).cast("int")
    ended = F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False))
    body = F.when(ended, F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
    out = ids
    for name, text in (prefixes or PREFIXES).items():
        head = F.array(*[F.lit(i).cast("int") for i in tokenizer.encode(text)])
        out = F.when(kind == name, F.concat(head, body, F.array(eos))).otherwise(out)
    return out


def task_prefixes(corpus: Corpus, tokenizer: Tokenizer | None = None) -> Corpus:
    ready = {"text_tokens", "kind"}
    return corpus.map(lambda _, df: df.withColumn("text_tokens", add_task_prefix(F.col("text_tokens"), F.col("kind"), tokenizer)) if ready <= set(df.columns) else df)


def multitask(corpus: Corpus, train: str = "train", validation: str = "validation", shuffle_train: bool = False, shuffle_validation: bool = False, seed: int = 42, multiplier: int = 1, key: str | None = None) -> Corpus:
    """train = documents (repeated) and train queries, validation = validation queries; the sources go, token columns are renamed."""
    sources = (DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES)
    for name in (train, validation):
        corpus.check_output(name, sources)
    both = repeat_rows(corpus[DOCUMENTS], multiplier).unionByName(corpus[TRAIN_QUERIES])
    held = corpus[VALIDATION_QUERIES]
    if shuffle_train:
        both = both.orderBy(shuffle_key(seed, "multitask", key or "docid"))
    if shuffle_validation:
        held = held.orderBy(shuffle_key(seed, "multitask", key or "docid"))
    return rename_token_columns(corpus.without(*sources).merge(extra={train: both, validation: held}))
