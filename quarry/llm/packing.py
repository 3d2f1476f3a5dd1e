"""Sum-of-squares online packing of tokenised documents into windows of a fixed capacity.

Every document is tokenised whole, closed with an end id and cut where it has to be: full windows first, then one rest that the
online rule places. The rule keeps an array with the number of open windows at each fill level and puts a rest where the sum
of the squared counts becomes least, which keeps the levels diverse and so leaves a partner for whatever comes next. At the end of a
packer's documents those of the windows that are still open are placed once more, whole, largest first, each at the fullest level that
has room for it. Only what room is then left is filled by cutting documents of the emptiest windows, and the last window is cut into
lengths that are powers of two, which need no padding.

Texts are tokenised in as many tasks as the input has partitions, and the ids are written. Packers then read about PACKER_TOKENS of
them each, whole partitions of the written table and no shuffle: so few windows are open at a packer's end beside those that the rule
has filled, however finely the input was cut. Sequence ids carry the packer's number, so a task that is run again after the loss of an
executor gives the same rows. A packer holds the ids of its open windows: some of the rule's levels have a few, 16 KB each at most.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise
from quarry.llm.words import NOT_SPACE, SLICE, batch_words, give_back, text_slices

CAPACITY = 4096
END_ID = 2
#: Ids that one packer gets.
PACKER_TOKENS = 1 << 25
#: Words and pieces of words that one worker remembers, about 60 MB of them: workers live on and keep that.
MOST_WORDS, MOST_PIECES = 300_000, 100_000
ROWS_OUT = 20_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if visible, else the next letter from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


class WordIds:
    """Ids of whole texts, word by word, each different word worked out once.

    White space separates words and leaves no token of its own, so that the ids of a text are those of its words in turn. Words
    of ASCII and Latin letters take a short way: lower case, the tokenizer's split, then the merges of its model for each new
    piece. All other words, and those that may hold a special token, are encoded by the tokenizer itself.
    """

    PLAIN = regex.compile(r"[\x21-\x3b\x3d-\x7e¡-įı-ɏ]+")
    PLAIN_LINES = regex.compile(r"[\n\x21-\x3b\x3d-\x7e¡-įı-ɏ]+")

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.most = most
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        shape, normal = str(self.tokenizer.pre_tokenizer), str(self.tokenizer.normalizer)
        # Words can be told apart beforehand only where white space is no part of any token and letters are lower-cased.
        steps = regex.findall(r"(\w+)\(", normal.replace("Sequence(normalizers=", ""))
        self.by_words = "Lowercase" in steps and set(steps) <= {"NFC", "Lowercase", "Replace", "Regex"} and normal.count("Replace(") == normal.count('Replace(pattern=Regex("\\s+"), content=" ")')
        found = regex.search(r'Regex\("((?:[^"\\]|\\.)*)"\)', shape)
        self.split = regex.compile(found[1].replace("\\\\", "\\")) if found and "behavior=Removed, invert=True" in shape else None
        self.by_words = self.by_words and self.split is not None and not self.split.search(" \t\n")
        self.split_lines = regex.compile(f"\n|{self.split.pattern}") if self.split else None
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.keys, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            got = self.pieces[piece] = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return got

    def ids_of(self, texts: list[str], parts: list[bytes], counts: list[int]) -> None:
        """Append the ids of these words, in pieces, and how many bytes of ids each word has."""
        known = self.pieces
        if len(texts) > 1 and self.split is not None and self.PLAIN_LINES.fullmatch(lines := "\n".join(texts)):
            n = 0
            for piece in self.split_lines.findall(lines.lower()):
                if piece == "\n":
                    counts.append(n)
                    n = 0
                else:
                    ids = known.get(piece) or self.piece(piece)
                    parts.append(ids)
                    n += len(ids)
            counts.append(n)
        elif len(texts) > 64:
            half = len(texts) // 2
            self.ids_of(texts[:half], parts, counts)
            self.ids_of(texts[half:], parts, counts)
        else:
            for text in texts:
                if self.split is not None and self.PLAIN.fullmatch(text):
                    mine = [self.piece(piece) for piece in self.split.findall(text.lower())]
                else:
                    mine = [array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()]
                parts += mine
                counts.append(sum(map(len, mine)))

    def learn(self, keys: np.ndarray, place: np.ndarray, texts: list[str]) -> None:
        """Add new words; `place` is where their keys belong among the sorted ones."""
        parts: list[bytes] = []
        counts: list[int] = []
        self.ids_of(texts, parts, counts)
        ids = np.frombuffer(b"".join(parts), np.uint32)
        ends = np.cumsum(counts) // 4
        while self.used + len(ids) > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        bounds = np.concatenate([[0], ends]).astype(np.int64)
        self.slots = np.insert(self.slots, place, np.arange(self.start.size, self.start.size + len(texts)))
        self.keys = np.insert(self.keys, place, keys)
        self.start = np.concatenate([self.start, self.used + bounds[:-1]])
        self.length = np.concatenate([self.length, np.diff(bounds)])
        self.used += len(ids)

    def encode(self, column: pa.Array, most: int = 2 * SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of the rows in turn, where each row's ids start and the last ones end), slice by slice."""
        if not self.by_words:
            for lo, hi, data, offsets in text_slices(column, most):
                texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
                own = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
                yield lo, np.concatenate([np.zeros(0, np.uint32), *own]), np.cumsum([0, *(x.size for x in own)])
            return
        for words in batch_words(column, NOT_SPACE, lower=False, most=most):
            if self.keys.size > self.most:
                self.forget()
            if len(self.pieces) > MOST_PIECES:
                self.pieces.clear()
            keys, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, keys)
            new = np.ones(keys.size, dtype=bool)
            inside = place < self.keys.size
            new[inside] = self.keys[place[inside]] != keys[inside]
            if new.any():
                data, at = words.data.tobytes(), at[new]
                spans = zip(words.starts[at].tolist(), words.ends[at].tolist())
                self.learn(keys[new], place[new], [data[a:b].decode() for a, b in spans])
                place = np.searchsorted(self.keys, keys)
            slots = self.slots[place][which]
            length = self.length[slots]
            total = np.zeros(length.size + 1, dtype=np.int64)
            np.cumsum(length, out=total[1:])
            ids = self.pool[np.repeat(self.start[slots] - total[:-1], length) + np.arange(total[-1])]
            yield words.lo, ids, total[words.first]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _size(window: list) -> int:
    return sum(len(p[2]) for p in window) // 4


def cut_off(window: list, size: int) -> list:
    """Take ids of this number out of a window, from its largest document on; a document that is only partly taken keeps its end."""
    taken = []
    window.sort(key=lambda p: len(p[2]))
    while size:
        document, start, ids = window.pop()
        took = ids[: 4 * size]
        taken.append((document, start, took))
        size -= len(took) // 4
        if len(took) < len(ids):
            window.append((document, start + len(took) // 4, ids[len(took) :]))
    return taken


def by_powers(window: list) -> list[list]:
    """A window cut into windows whose lengths are powers of two; its small documents come first and so are rarely cut."""
    closed, left = [], sorted(window, key=lambda p: -len(p[2]))
    while left:
        room, part = 1 << (_size(left).bit_length() - 1), []
        while room:
            document, start, ids = left.pop()
            took = ids[: 4 * room]
            part.append((document, start, took))
            room -= len(took) // 4
            if len(took) < len(ids):
                left.append((document, start + len(took) // 4, ids[len(took) :]))
        closed.append(part)
    return closed


class SumOfSquares:
    """Online packer. `add` and `finish` return closed windows: lists of (document, start, ids)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The level (0: a new window) at which adding `size` makes the sum of squared counts least; ties go to the fullest."""
        last = self.capacity - size
        n = self.levels
        at = np.flatnonzero(n[: last + 1])
        best, cost = 0, 2 * int(n[size]) + 1 if size < self.capacity else 0
        if at.size:
            to = at + size
            change = np.where(to == self.capacity, 1 - 2 * n[at], 2 * (n[to] - n[at] + 1))
            k = change.size - 1 - int(np.argmin(change[::-1]))
            if change[k] <= cost:
                best = int(at[k])
        return best

    def add(self, document: int, ids: bytes) -> list[list]:
        total, full, closed = len(ids) // 4, self.capacity, []
        cut = total - total % full
        for start in range(0, cut, full):
            closed.append([(document, start, ids[4 * start : 4 * (start + full)])])
        size = total - cut
        if size:
            closed += self.place((document, cut, ids[4 * cut :]), self.level_for(size))
        return closed

    def take(self, level: int) -> list:
        """An open window of this level, no longer open."""
        self.levels[level] -= 1
        return self.open[level].pop()

    def place(self, piece: tuple, level: int) -> list[list]:
        """Put a piece into a window of this level (0: a new one), which is closed if it is full."""
        window = [*self.take(level), piece] if level else [piece]
        level += len(piece[2]) // 4
        if level == self.capacity:
            return [window]
        self.open.setdefault(level, []).append(window)
        self.levels[level] += 1
        return []

    def finish(self) -> list[list]:
        """Close what is open, after its documents were placed anew: largest first, each at the fullest level with room for it."""
        pieces = sorted((p for windows in self.open.values() for w in windows for p in w), key=lambda p: -len(p[2]))
        self.open.clear()
        self.levels[:] = 0
        closed, full = [], self.capacity
        for piece in pieces:
            fits = np.flatnonzero(self.levels[: self.capacity - len(piece[2]) // 4 + 1])
            closed += self.place(piece, int(fits[-1]) if fits.size else 0)
        windows = [w for level in sorted(self.open) for w in self.open[level]]
        self.open.clear()
        at = 0
        for k in range(len(windows) - 1, -1, -1):
            while at < k and (room := full - _size(windows[k])):
                windows[k] += cut_off(windows[at], min(room, _size(windows[at])))
                at += not windows[at]
            if at < k or _size(windows[k]) == full:
                closed.append(windows[k])
            elif windows[k]:
                return closed + by_powers(windows[k])
            if at >= k:
                break
        return closed


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end: bytes) -> Iterator[pa.RecordBatch]:
    """doc_id, n, ids (little-endian) of every text, with the end id."""
    words = word_ids(tokenizer)
    for batch in batches:
        for lo, all_ids, bounds in words.encode(batch.column(1)):
            ids = [all_ids[a:b].tobytes() + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(ids)), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])


def _packed(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    packer = SumOfSquares(capacity)
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 40
    rows: list[tuple] = []

    def take(closed: list[list]) -> None:
        nonlocal sequence
        for window in closed:
            offset = 0
            for document, start, ids in window:
                doc_id, tokens = document
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, schema=ARROW)
        rows.clear()
        return batch

    for batch in batches:
        ids = batch.column(1)
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            mine = ids[k].as_py()
            take(packer.add((doc_id, len(mine) // 4), mine))
            if len(rows) >= ROWS_OUT:
                yield out()
        del batch, ids
        give_back()
    take(packer.finish())
    yield out()


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """One row for each piece of a document: where it starts, its length, the checksum of its ids, its sequence and offset.

    Null and empty texts are the end id alone. Repeated rows are packed once for each row. An empty table gives no row. Ties of
    the placement rule go to the fullest level. Only doc_id and text are read; other columns, whatever their names, are not
    carried. Texts of any length are tokenised whole and cut into as many windows as they fill.
    """
    path, end = tokenizer or default_tokenizer(), array("I", [end_id]).tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialise(rows.mapInArrow(lambda batches: _encoded(batches, path, end), "doc_id long, n long, ids binary"), "token-ids")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return table.select("doc_id", "ids").coalesce(max(1, -(-total // packer_tokens))).mapInArrow(lambda batches: _packed(batches, capacity), SCHEMA)
