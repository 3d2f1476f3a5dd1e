"""A double-array trie over byte strings, and longest matches of many words at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class DoubleArray:
    """Node n has the child for byte b at base[n] + b if check[] of that place is n; value[n] is the entry that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, entries: dict[bytes, int]) -> DoubleArray:
        """Level by level; a node's children take the first place where all of them fit.

        Only children take the holes. Siblings are not tried where many siblings before them have not fitted.
        """
        keys = sorted(entries)
        size = 512
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        hole = crowded = 1
        level = [(0, 0, len(keys))] if keys else []
        depth = 0
        while level:
            below = []
            for node, lo, hi in level:
                if len(keys[lo]) == depth:
                    value[node] = entries[keys[lo]]
                    lo += 1
                children: list[tuple[int, int, int]] = []
                while lo < hi:
                    byte, start = keys[lo][depth], lo
                    while lo < hi and keys[lo][depth] == byte:
                        lo += 1
                    children.append((byte, start, lo))
                if not children:
                    continue
                if len(children) == 1:
                    while check[hole] >= 0 or hole <= children[0][0]:
                        hole += 1
                    at = hole - children[0][0]
                else:
                    at, tried = crowded, 0
                    while any(check[at + byte] >= 0 for byte, _, _ in children):
                        at, tried = at + 1, tried + 1
                        if at + 512 >= size:
                            base, check, value, size = base + [0] * size, check + [-1] * size, value + [-1] * size, 2 * size
                    if tried > 64:
                        crowded = at - 32
                base[node] = at
                for byte, start, end in children:
                    check[at + byte] = node
                    below.append((at + byte, start, end))
                if max(at, hole) + 512 >= size:
                    base, check, value, size = base + [0] * size, check + [-1] * size, value + [-1] * size, 2 * size
            level, depth = below, depth + 1
        return cls(np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32))

    def child(self, node: int, byte: int) -> int:
        """-1 if there is none."""
        at = int(self.base[node]) + byte
        return at if node >= 0 and self.check[at] == node and at else -1

    def longest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
        """(value, end) of the longest entry below `root` that each span begins with; -1 and the span's start if there is none."""
        value, end = np.full(len(starts), -1, np.int64), starts.copy()
        if root < 0:
            return value, end
        node, at, live = np.full(len(starts), root, np.int64), starts.copy(), np.arange(len(starts))
        while live.size:
            live = live[at[live] < ends[live]]
            to = self.base[node[live]].astype(np.int64) + data[at[live]]
            there = self.check[to] == node[live]
            live, to = live[there], to[there]
            node[live], at[live] = to, at[live] + 1
            found = self.value[to]
            hit = live[found >= 0]
            value[hit], end[hit] = found[found >= 0], at[hit]
        return value, end
