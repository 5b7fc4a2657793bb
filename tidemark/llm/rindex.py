"""Run-length (r-)index over a small collection of byte strings.

The Burrows-Wheeler transform of a repetitive collection has few runs. Only at
the run ends are the lexicographic predecessor of a text position and the
length of their common prefix kept; for every other position both follow from
the next sample to its right (one step left in the text keeps the neighbour and
lengthens the match by one while the transform stays in its run). Streaming
over the text so gives the matching statistics of each position against the
rest of the collection.
"""

from __future__ import annotations

import numpy as np

from .textops import U64

#: Symbols in a sort key: 7 symbols of 9 bits (0 ends a string, byte b is b + 1).
SEED = 7


class RunIndex:
    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
        ends = self.starts + size
        raw[ends] = 0
        self.n = len(raw)
        self.end = np.repeat(ends, size + 1)
        self.text = raw
        order, levels = self._sort()
        self._sample(order, levels)

    def _sort(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by prefix doubling (a suffix stops at its string's end; ties by place), and ranks per length.

        Each round looks at the suffixes that are still tied only.
        """
        padded = np.concatenate((self.text, np.zeros(SEED, self.text.dtype))).astype(U64)
        key, inside = np.zeros(self.n, U64), np.ones(self.n, U64)
        for k in range(SEED):
            symbol = padded[k : k + self.n] * inside
            key = (key << U64(9)) | symbol
            inside = (symbol > 0).astype(U64)
        self.key = key
        order = np.argsort(key)
        sorted_key = key[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        size = np.diff(np.append(first, self.n))
        group = np.repeat(first, size)
        rank = np.empty(self.n, np.int32)
        rank[order] = group
        order[: size[0]].sort()  # the string ends
        slot = np.flatnonzero(np.repeat(size > 1, size) & (group > 0))
        at, group = order[slot], group[slot]
        levels, h = [(SEED, rank)], SEED
        longest = int((self.end - np.arange(self.n)).max())
        while h < longest and len(slot):
            then = rank[np.minimum(at + h, self.end[at])]
            perm = np.argsort((group << 32) | then)
            at, then = at[perm], then[perm]
            order[slot] = at
            first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (then[1:] != then[:-1]))))
            size = np.diff(np.append(first, len(slot)))
            group = np.repeat(slot[first], size)
            rank = rank.copy()
            rank[at] = group
            h *= 2
            levels.append((h, rank))
            tied = np.repeat(size > 1, size)
            slot, at, group = slot[tied], at[tied], group[tied]
        order[slot] = at[np.argsort((group << 32) | at)]
        return order, levels

    def _sample(self, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> None:
        slot = np.empty(self.n, np.int64)
        slot[order] = np.arange(self.n)
        bwt = self.text[order - 1]
        head = np.concatenate(([True], bwt[1:] != bwt[:-1])) | (bwt == 0)
        # a sample before each run head, and before each string's end
        i = np.flatnonzero(self.text)
        keep = head[slot[i + 1]] | (self.text[i + 1] == 0)
        at = i[keep]
        before = order[np.maximum(slot[at] - 1, 0)]
        self.runs = int(head.sum())
        self.sample, self.neighbour = at, before
        self.next_sample = np.cumsum(keep) - keep
        self.match = np.where(self.text[before] == 0, 0, self._common(at, before, levels))

    def _common(self, x: np.ndarray, y: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        end_x, end_y = self.end[x], self.end[y]
        most = np.minimum(end_x - x, end_y - y)
        got = np.zeros(len(x), np.int64)
        for h, rank in reversed(levels):
            same = rank[np.minimum(x + got, end_x)] == rank[np.minimum(y + got, end_y)]
            got += h * same
            np.minimum(got, most, out=got)
        differ = self.key[np.minimum(x + got, end_x)] ^ self.key[np.minimum(y + got, end_y)]
        for k in range(1, SEED):
            got += differ < U64(1 << 9 * k)
        return np.minimum(got, most)

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: (text position, its predecessor's position, length of their match)."""
        i = np.flatnonzero(self.text)
        s = self.next_sample
        back = self.sample[s] - i
        return i, self.neighbour[s] - back, self.match[s] + back

    def equal_windows(self, width: int) -> np.ndarray:
        """For each text position, one position that stands for all with an equal window of ``width``."""
        i, other, length = self.stream()
        root = np.arange(self.n)
        long = length >= width
        root[i[long]] = other[long]
        while True:
            up = root[root]
            if np.array_equal(up, root):
                return root
            root = up
