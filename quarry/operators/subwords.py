"""Subword ids: words matched greedily, longest piece first, against a vocabulary table.

Splitting a text into words is a native expression. Words are matched by a double-array trie that all executors get; the vocabulary's
size is checked before it is sent. The words of whole texts (`encode`) are matched where their rows lie, each *different* one of a batch
once, and nothing is shuffled. Of titles and prefixes (`with_ids`) only the different words of the table are matched, and come back by
a join on the word, whose side has one row for it, so the adaptive skew join can split a frequent word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.trie import DoubleArray

#: Pieces of a vocabulary, at most: a trie of some 60 MB.
MOST_PIECES = 1 << 20
#: Rows whose words are matched at a time.
ROWS = 500

# What is a word. Control and format characters go, except tab and line ends.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}\p{Cf}]"
_MARKS = r"!-/:-@\[-`{-~\p{P}"
_IDEOGRAPHS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
#: A punctuation mark, an ideograph, or a run of anything else without white space.
WORD = rf"[{_MARKS}{_IDEOGRAPHS}]|[^\s\p{{Z}}{_MARKS}{_IDEOGRAPHS}]+"
#: Spaces that go when words are joined to a text again, in this order.
JOINTS = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))

_FIRST, _NEXT = b"\x00", b"\x01"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and their ids. A piece that continues a word has the mark `continuation` in front; a vocabulary that marks word ends
    instead names that mark as `word_end` and has no `continuation`.

    lower: words are matched in lower case and without accents. A word of more than `most_characters`, or with a part that no piece
    matches, is the one id `unk_id`.
    """

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    unknown: str = "[UNK]"
    end: str = "[SEP]"
    continuation: str = "##"
    word_end: str = ""
    lower: bool = True
    most_characters: int = 100
    _built: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def of(cls, table: DataFrame, **options) -> Vocabulary:
        """From a table (piece, id)."""
        rows = table.select("piece", F.col("id").cast("int")).limit(MOST_PIECES + 1).collect()
        if len(rows) > MOST_PIECES:
            raise ValueError(f"a vocabulary has at most {MOST_PIECES} pieces")
        rows.sort(key=lambda r: r[1])
        return cls(tuple(r[0] for r in rows), tuple(r[1] for r in rows), **options)

    @classmethod
    def read(cls, spark: SparkSession, path: str, **options) -> Vocabulary:
        """From a text file with a piece in each line; its id is the line's number, from 0."""
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), "\r?\n")).alias("id", "piece"))
        return cls.of(lines, **options)

    def id_of(self, piece: str) -> int | None:
        if "by_piece" not in self._built:
            self._built["by_piece"] = dict(zip(self.pieces, self.ids))
        return self._built["by_piece"].get(piece)

    @property
    def eos_id(self) -> int | None:
        return self.id_of(self.end)

    @property
    def unk_id(self) -> int:
        found = self.id_of(self.unknown)
        if found is None:
            raise ValueError(f"the vocabulary lacks {self.unknown!r}")
        return found

    @property
    def vocab_size(self) -> int:
        return max(self.ids) + 1

    def trie(self) -> DoubleArray:
        """One trie of both sorts of pieces, told apart by a first byte that no word has."""
        if "trie" not in self._built:
            entries: dict[bytes, int] = {}
            for piece, k in zip(self.pieces, self.ids):
                if piece in (self.unknown, self.end) or not piece:
                    continue
                if self.continuation and piece.startswith(self.continuation) and len(piece) > len(self.continuation):
                    entries[_NEXT + piece[len(self.continuation) :].encode()] = k
                else:
                    entries[_FIRST + piece.encode()] = k
            self._built["trie"] = DoubleArray.of(entries)
        return self._built["trie"]

    def matcher(self) -> Matcher:
        return Matcher(self.trie(), self.unk_id, self.unknown, self.word_end, bool(self.continuation), self.lower, self.most_characters)

    def words(self, text: Column | str) -> Column:
        """array<string> of a text's words; of a null one, none."""
        cleaned = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), CONTROL, "")
        return F.regexp_extract_all(F.lower(cleaned) if self.lower else cleaned, F.lit(WORD), F.lit(0))

    def encode(self, text: str) -> list[int]:
        """A short text's ids, on the driver: prefixes of tasks and the like."""
        if not text.isascii():
            raise ValueError("only ASCII texts are encoded on the driver; use with_ids")
        import re

        words = re.findall(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+", re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", text.lower() if self.lower else text))
        return [i for ids in self.matcher().match(pa.array(words, pa.string()))[0].to_pylist() for i in ids]


@dataclass(frozen=True)
class Matcher:
    trie: DoubleArray
    unk_id: int
    unknown: str
    word_end: str
    continues: bool
    lower: bool
    most_characters: int

    def match(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, the word as its ids show it; null for a word of which nothing is left) of many words, a piece of each at a time."""
        if self.lower:
            words = pc.replace_substring_regex(pc.utf8_normalize(words, "NFD"), r"\p{Mn}", "")
        shown = words
        ended = pc.binary_join_element_wise(words, self.word_end, "") if self.word_end else words
        ended = ended.cast(pa.large_string())
        offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
        data = np.frombuffer(ended.buffers()[2], np.uint8) if ended.buffers()[2] is not None and ended.buffers()[2].size else np.zeros(1, np.uint8)
        starts, ends = offsets[:-1].copy(), offsets[1:]
        blank = pc.equal(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False).astype(bool)
        failed = pc.greater(pc.utf8_length(words), self.most_characters).to_numpy(zero_copy_only=False).astype(bool)
        live = np.flatnonzero(~blank & ~failed)
        root = self.trie.child(0, _FIRST[0])
        onwards = self.trie.child(0, _NEXT[0]) if self.continues else root
        of, ids = [np.flatnonzero(failed)], [np.full(int(failed.sum()), self.unk_id, np.int64)]
        while live.size:
            value, end = self.trie.longest(data, starts[live], ends[live], root)
            lost = live[value < 0]
            failed[lost] = True
            live, value, end = live[value >= 0], value[value >= 0], end[value >= 0]
            of.append(live)
            ids.append(value)
            starts[live] = end
            live, root = live[end < ends[live]], onwards
        of_all, ids_all, partly = np.concatenate(of), np.concatenate(ids), failed.copy()
        first = len(of[0])
        keep = np.ones(len(of_all), bool)
        keep[first:] = ~partly[of_all[first:]]
        late = np.setdiff1d(np.flatnonzero(failed), of[0])
        of_all, ids_all = np.concatenate([of_all[keep], late]), np.concatenate([ids_all[keep], np.full(len(late), self.unk_id, np.int64)])
        order = np.argsort(of_all, kind="stable")
        sizes = np.bincount(of_all, minlength=len(words))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids_all[order].astype(np.int32)))
        shown = pc.if_else(pa.array(failed), self.unknown, shown)
        return lists, pc.if_else(pa.array(blank), pa.scalar(None, shown.type), shown)


def _encoded(matcher: Matcher, words: pa.Array) -> pa.Array:
    """struct(ids, shown) of rows of words. Each different word of the batch is matched once."""
    coded = pc.dictionary_encode(words.flatten())
    lists, names = matcher.match(coded.dictionary.cast(pa.string()))
    edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    found = pc.take(lists, coded.indices)
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids = pa.ListArray.from_arrays(pa.array(upto[edges].astype(np.int32)), found.flatten().cast(pa.int32()))
    said = pc.take(names.cast(pa.string()), coded.indices)
    left = np.concatenate([[0], np.cumsum(pc.is_valid(said).to_numpy(zero_copy_only=False))]).astype(np.int64)
    shown = pa.ListArray.from_arrays(pa.array(left[edges].astype(np.int32)), said.drop_null())
    return pa.StructArray.from_arrays([ids, shown], ["ids", "shown"])


def encode_words(spark: SparkSession, words: Column | str, vocabulary: Vocabulary) -> Column:
    """struct(ids, shown) of an array of words; an empty or null one has no ids. Rows stay where they are: nothing is shuffled."""
    shared = spark.sparkContext.broadcast(vocabulary.matcher())

    @F.arrow_udf("ids array<int>, shown array<string>")
    def run(batch: pa.Array) -> pa.Array:
        # Slices of rows bound what is held besides the batch.
        parts = [_encoded(shared.value, batch[lo : lo + ROWS]) for lo in range(0, len(batch), ROWS)]
        return pa.concat_arrays(parts) if parts else _encoded(shared.value, batch)

    return run(F.col(words) if isinstance(words, str) else words)


def encode(rows: DataFrame, key: list[str], words: str, vocabulary: Vocabulary) -> DataFrame:
    """key, ids, shown (the words as their ids show them) of rows with an array of words; an empty one has no ids."""
    return rows.select(*key, encode_words(rows.sparkSession, words, vocabulary).alias("_encoded")).select(*key, "_encoded.ids", "_encoded.shown")


def match_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word, ids, shown for a table of different words."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary.matcher())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word")
            ids, shown = shared.value.match(word)
            yield pa.RecordBatch.from_arrays([word, ids, shown.cast(pa.string())], ["word", "ids", "shown"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>, shown string")


def _joined(rows: DataFrame, key: list[str], words: str, vocabulary: Vocabulary) -> DataFrame:
    """`encode` by a join on the different words of all rows, for short texts of which many are alike; the key is unique."""
    parts = rows.select(*key, F.posexplode_outer(words).alias("_pos", "word"))
    matched = match_words(parts.where("word is not null").select("word").distinct(), vocabulary)
    placed = parts.join(matched, "word", "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "ids", "shown"))).alias("_all"))
    some = F.filter("_all", lambda x: x["_pos"].isNotNull())
    return placed.select(*key, F.flatten(F.transform(some, lambda x: x["ids"])).alias("ids"), F.filter(F.transform(some, lambda x: x["shown"]), lambda s: s.isNotNull()).alias("shown"))


def with_ids(df: DataFrame, text: Column | str, vocabulary: Vocabulary, into: str = "ids", shown: str | None = None, most: int | None = None) -> DataFrame:
    """df and the ids of a text column; each different text is encoded once. `most` bounds the words and so the ids of interest:
    a word has at least one id, but for one that is all accents."""
    words = vocabulary.words(text)
    words = words if most is None else F.slice(words, 1, most)
    keyed = df.withColumn("_words", words).withColumn("_digest", F.md5(F.array_join("_words", " ")))
    found = _joined(keyed.select("_digest", "_words").dropDuplicates(["_digest"]), ["_digest"], "_words", vocabulary)
    found = found.select("_digest", F.col("ids").alias(into), *([F.col("shown").alias(shown)] if shown else []))
    return keyed.join(found, "_digest", "left").drop("_digest", "_words")


def shown_text(shown: Column | str) -> Column:
    """Words as a text: single spaces, but none before marks and short forms."""
    out = F.array_join(shown, " ")
    for apart, joined in JOINTS:
        out = F.replace(out, F.lit(apart), F.lit(joined))
    return F.trim(out)


def with_text(df: DataFrame, ids: str, vocabulary: Vocabulary, into: str = "text") -> DataFrame:
    """df and the text that a column of ids stands for, special ones left out; each different list is turned back once."""
    spark = df.sparkSession
    special = {vocabulary.unk_id, vocabulary.eos_id}
    table = spark.createDataFrame([(i, p) for i, p in zip(vocabulary.ids, vocabulary.pieces) if i not in special], "_id int, _piece string")
    keyed = df.withColumn("_list", F.array_join(ids, ","))
    parts = keyed.select("_list", ids).dropDuplicates(["_list"]).select("_list", F.posexplode(ids).alias("_pos", "_id"))
    found = parts.join(F.broadcast(table), "_id").groupBy("_list").agg(F.array_sort(F.collect_list(F.struct("_pos", "_piece"))).alias("_all"))  # of bounded size
    text = F.array_join(F.transform("_all", lambda x: x["_piece"]), " ")
    if vocabulary.continuation:
        text = F.replace(text, F.lit(" " + vocabulary.continuation), F.lit(""))
    if vocabulary.word_end:
        text = F.replace(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(vocabulary.word_end), F.lit(" ")), F.lit("  "), F.lit(" "))
    shown = found.select("_list", shown_text(F.split(text, " ")).alias("_text"))
    return keyed.join(shown, "_list", "left").withColumn(into, F.coalesce("_text", F.lit(""))).drop("_list", "_text")
