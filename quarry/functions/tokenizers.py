"""Tokenizers as column expressions.

The default is byte-level: an id is a byte's value plus three; 0 pads, 1 ends, 2 is unknown. Its encoder and decoder are native
expressions. A tokenizer over a fixed vocabulary of words, and any object with encode and decode, run as Arrow functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


class Tokenizer(Protocol):
    eos_id: int | None
    unk_id: int
    vocab_size: int

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


@dataclass(frozen=True)
class ByteTokenizer:
    eos_id: int = 1
    unk_id: int = 2
    pad_id: int = 0
    offset: int = 3
    vocab_size: int = 259

    def encode(self, text: str) -> list[int]:
        return [b + self.offset for b in text.encode()]

    def decode(self, ids: list[int]) -> str:
        return bytes(i - self.offset for i in ids if i >= self.offset).decode(errors="ignore")


@dataclass(frozen=True)
class WordTokenizer:
    """White-space words of a fixed vocabulary; all others are unknown. Build the vocabulary with a grouped count."""

    words: tuple[str, ...]
    eos_id: int = 1
    unk_id: int = 2

    @property
    def vocab_size(self) -> int:
        return len(self.words) + 3

    def encode(self, text: str) -> list[int]:
        known = self.__dict__.get("_known")
        if known is None:
            known = {w: k + 3 for k, w in enumerate(self.words)}
            object.__setattr__(self, "_known", known)
        return [known.get(w, self.unk_id) for w in text.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.words[i - 3] if i >= 3 else "<unk>" for i in ids if i == self.unk_id or i >= 3)


BYTES = ByteTokenizer()


def encode_column(text: Column, tokenizer: Tokenizer | None = None) -> Column:
    """array<int> of ids without an end id; null for null."""
    if tokenizer is None or isinstance(tokenizer, ByteTokenizer):
        shift = (tokenizer or BYTES).offset
        # As ISO-8859-1 a byte is the character of the same number. The empty text is split into one empty character.
        chars = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
        return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c) + shift)

    @pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokenizer.encode(t))

    return encoded(text)


#: One well-formed UTF-8 sequence, with bytes written as the characters of the same number.
_SEQUENCE = (
    "[\\x00-\\x7F]|[\\xC2-\\xDF][\\x80-\\xBF]|\\xE0[\\xA0-\\xBF][\\x80-\\xBF]|[\\xE1-\\xEC\\xEE\\xEF][\\x80-\\xBF]{2}|\\xED[\\x80-\\x9F][\\x80-\\xBF]"
    "|\\xF0[\\x90-\\xBF][\\x80-\\xBF]{2}|[\\xF1-\\xF3][\\x80-\\xBF]{3}|\\xF4[\\x80-\\x8F][\\x80-\\xBF]{2}"
)


def _decode_bytes(ids: Column, offset: int) -> Column:
    """The bytes of ids from the offset on, as text; what is no UTF-8 (a character that a limit cut) is left out."""
    too_large = F.raise_error(F.lit("an id is no byte")).cast("string")
    digits = F.transform(F.filter(ids, lambda i: i >= offset), lambda i: F.when(i - offset > 255, too_large).otherwise(F.lpad(F.hex(i - offset), 2, "0")))
    raw = F.unhex(F.array_join(digits, ""))
    whole = F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(_SEQUENCE), 0)
    mended = F.encode(F.array_join(whole, ""), "ISO-8859-1").cast("string")
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(mended)


def decode_column(ids: Column, tokenizer: Tokenizer | None = None) -> Column:
    """The text of ids without special ones; null for null. Of bytes by native expressions."""
    tokenizer = tokenizer or BYTES
    if isinstance(tokenizer, ByteTokenizer):
        return _decode_bytes(ids, tokenizer.offset)

    @pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else tokenizer.decode([int(i) for i in r]))

    return decoded(ids)


def round_trip_column(text: Column, tokenizer: Tokenizer | None = None) -> Column:
    """A text as its tokenizer gives it back; with bytes, the text itself."""
    text = F.coalesce(text, F.lit(""))
    return text if tokenizer is None or isinstance(tokenizer, ByteTokenizer) else decode_column(encode_column(text, tokenizer), tokenizer)
