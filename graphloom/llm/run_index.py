"""A run-length index of a small collection: its run-compressed Burrows-Wheeler transform with sampled run ends.

Suffixes are put in order by naming: equal stretches of 8, 16, 32, ... symbols
get equal numbers, in order, so a number of twice the length comes from two. In
that order the symbols before the suffixes are the transform; a run of equal
symbols is kept as its head and its two ends. The longest match of a suffix with
the one before it has to be measured at run heads only: inside a run it is one
less than the match of the position before, so one pass over the text gives all.
Names of one round only are held: matches at run heads are measured on the text,
eight symbols at a time. A symbol takes about 50 bytes while the index is made.
"""

from __future__ import annotations

import numpy as np


#: Run heads measured at once.
BLOCK = 1 << 17


def _named(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 in order of key, equal ones for equal keys."""
    order = np.argsort(key)
    new = (lambda x: x[1:] != x[:-1])(key[order])
    name = np.zeros(len(key), np.int32)
    name[order[1:]] = np.cumsum(new, dtype=np.int32)
    return name


class RunIndex:
    """Index of texts, each closed by a separator of its own, so no match leaves its text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        count, lengths = len(bounds) - 1, np.diff(bounds)
        n = len(data) + count
        self.ends = bounds[1:] + np.arange(count)
        self.starts = bounds[:-1] + np.arange(count)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        self.symbols = np.empty(n, np.int32)
        self.symbols[inside] = data
        self.symbols += 1
        self.symbols[self.ends] = -1 - np.arange(count)  # separators, told apart
        low = np.zeros(n + 8, np.uint8)
        low[:n][inside] = data + np.uint8(1)  # separators are 0; so is the byte 255, but it stands in no UTF-8 text
        self.packed = np.zeros(n, np.uint64)
        for i in range(8):
            self.packed <<= np.uint64(8)
            self.packed |= low[i : n + i]
        # the last eight places of each text and their symbols before the separator; what follows it does not count
        tail = np.minimum(lengths + 1, 8)
        text = np.repeat(np.arange(count), tail)
        left = np.repeat(np.cumsum(tail), tail) - np.arange(len(text)) - 1
        closing = self.ends[text] - left
        blank = np.minimum(64 - 8 * left, 63).astype(np.uint64)
        self.packed[closing] = np.where(left == 0, np.uint64(0), self.packed[closing] >> blank << blank)
        #: Places with eight symbols or more before the separator.
        self.full = np.ones(n, bool)
        self.full[closing] = False
        key = _named(self.packed) * np.int64(count + 1)
        key[closing] += text + 1
        name, width = _named(key), 8
        while name.max(initial=0) + 1 < n:
            key = name * np.int64(n + 1)
            key[: n - width] += name[width:] + 1
            name, width = _named(key), width * 2
        del key
        self.order = np.empty(n, np.int32)
        self.order[name] = np.arange(n, dtype=np.int32)
        transform = np.where(self.order > 0, self.symbols[self.order - 1], 0)
        #: Symbols of the runs; the samples are the suffixes at run heads and tails.
        head = np.concatenate([[True], transform[1:] != transform[:-1]])
        self.run_symbols = transform[head]
        self.head_samples = self.order[head]
        self.tail_samples = self.order[np.concatenate([head[1:], [True]])]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at a and b, which differ."""
        n = len(self.symbols)
        out = np.zeros(len(a), np.int32)
        at, x, y = np.arange(len(a)), a, b
        while len(at):
            same = self.full[x] & self.full[y] & (self.packed[x] == self.packed[y])
            at, x, y = at[same], x[same] + 8, y[same] + 8
            out[at] += 8
        going = np.ones(len(a), bool)
        for _ in range(7):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            going &= (self.symbols[x] == self.symbols[y]) & (x != y)
            out += going
        return out

    def longest_matches(self) -> np.ndarray:
        """For each place the length of its longest match with another one, streamed from the sampled run ends."""
        n = len(self.symbols)
        at_head = np.zeros(n, np.int32)
        for i in range(1, len(self.head_samples), BLOCK):
            at_head[self.head_samples[i : i + BLOCK]] = self.common(self.head_samples[i : i + BLOCK], self.tail_samples[i - 1 : i - 1 + BLOCK][: len(self.head_samples) - i])
        sampled = np.zeros(n, bool)
        sampled[self.head_samples] = True
        place = np.arange(n, dtype=np.int32)
        last = np.maximum.accumulate(np.where(sampled, place, np.int32(-1)))
        del sampled
        before = np.maximum(at_head[last] - (place - last), 0)
        del at_head, place, last
        out = before.copy()
        out[self.order[:-1]] = np.maximum(before[self.order[:-1]], before[self.order[1:]])
        return out
