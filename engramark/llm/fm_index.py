"""An FM-index over integer symbols: suffix array, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order; each 0 is an end, smaller than all symbols and than any later 0, so comparisons stop there.

    Prefix doubling: after each round only the suffixes whose place is still shared are sorted again.
    """
    n, ends = len(text), text == 0
    if not n:
        return np.zeros(0, np.int64)
    first = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum())).astype(np.int64)
    order = np.argsort(first, kind="stable")
    rank, step = np.empty(n + 1, np.int64), 1
    rank[n] = -1
    ordered = first[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    size = np.diff(np.append(start, n))
    # The rank of a suffix is the place of the first one of its group.
    rank[order] = np.repeat(start, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_):
        suffixes = order[open_]
        group = rank[suffixes]
        key = group * (n + 1) + rank[np.minimum(suffixes + step, n)] + 1
        by_key = np.argsort(key, kind="stable")
        suffixes, key, group = suffixes[by_key], key[by_key], group[by_key]
        # Groups lie at their places in ascending order, so that the sorted ones go back to the same places.
        order[open_] = suffixes
        start = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(key)))
        rank[suffixes] = np.repeat(open_[at], size)
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks of symbols in a sequence; the nodes of a level lie side by side, those reached by a 0 bit first."""

    def __init__(self, symbols: np.ndarray, most: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, most.bit_length()) - 1, -1, -1):
            bits = (symbols >> np.int32(shift) & np.int32(1)).astype(bool)
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.n = len(symbols)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        start, end = np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            on = (symbol >> shift & 1).astype(bool)
            ones_start, ones_end = bits.rank(start), bits.rank(end)
            start = np.where(on, zeros + ones_start, start - ones_start)
            end = np.where(on, zeros + ones_end, end - ones_end)
        return end - start

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol, start, end = np.zeros_like(i), np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            on = bits.get(end)
            symbol = symbol | on.astype(np.int64) << shift
            ones_start, ones_end = bits.rank(start), bits.rank(end)
            start = np.where(on, zeros + ones_start, start - ones_start)
            end = np.where(on, zeros + ones_end, end - ones_end)
        return symbol, end - start


class FMIndex:
    """Finds every occurrence of patterns in a text of symbols 1 to most; 0 separates parts, and no pattern crosses it."""

    def __init__(self, text: np.ndarray, most: int) -> None:
        text = np.concatenate([text.astype(np.int64), [0]])
        order = suffix_array(text)
        self.n = len(text)
        before = text[order - 1]
        self.tree = WaveletTree(before.astype(np.int32), most)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.marks, self.positions = Bits(sampled), order[sampled]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern; patterns are right-aligned in a matrix."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - step]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled one."""
        found = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows, 0
        while len(open_):
            hit = self.marks.get(at)
            found[open_[hit]] = self.positions[self.marks.rank(at[hit])] + steps
            open_, at = open_[~hit], at[~hit]
            symbol, before = self.tree.get(at)
            at = self.first[symbol] + before
            steps += 1
        return found
