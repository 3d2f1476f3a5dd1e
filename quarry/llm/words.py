"""Words of many texts at once, in numpy, straight from the UTF-8 buffer of an Arrow column.

A word is a maximal run of bytes of a class; the classes used here all treat bytes above 0x7F as word bytes, so that no character
is ever cut. A word's 64-bit hash depends on its bytes alone, not on the batch, the row or the machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time: bounds the temporary arrays, whatever the size of a batch.
SLICE = 1 << 20
#: Bytes of text whose spans are hashed at a time.
RUN = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words end at white space of ASCII.
NOT_SPACE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are digits, lower-case letters and everything above ASCII (texts are lower-cased before).
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the step and of its inverse, modulo 2**64."""
    global _powers
    if _powers[0].size <= n:
        tables = []
        for base in (_STEP, _BACK):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = (tables[0], tables[1])
    return _powers


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of the bytes of each span; spans come in the order of their starts.

    A hash does not depend on where its span stands, so runs of spans are worked out one after another, in little memory.
    """
    out = np.empty(starts.size, dtype=np.uint64)
    lo = 0
    while lo < starts.size:
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(starts, base + RUN)))
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        size = int(b.max())
        forward, back = _power_tables(size)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[base : base + size]] * back[:size], out=total[1:])
        out[lo:hi] = mix((total[b] - total[a]) * forward[a] + (b - a).astype(np.uint64))
        lo = hi
    return out


@dataclass
class Words:
    """The words of the rows lo..hi of a batch. Row r has the words first[r - lo] .. first[r - lo + 1] - 1."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system. Workers outlive their tasks, and what one keeps is missing to its executor's other work."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_slices(column: pa.Array, most: int = SLICE, rows: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of runs of at most `rows` rows and `most` bytes, or of one longer row."""
    if not len(column):
        return
    offsets, data = _buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, lo + rows, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    del offsets, data
    give_back()


def words_of(lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if data.size:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < data.size]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(lo, hi, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def batch_words(column: pa.Array, table: np.ndarray, lower: bool = True, most: int = SLICE) -> Iterator[Words]:
    """The words of a string column, in slices of rows; `lower` turns A-Z into a-z first."""
    for lo, hi, data, offsets in text_slices(column, most):
        yield words_of(lo, hi, _LOWER[data] if lower else data, offsets, table)
