"""A compressed full-text index over sequences of word numbers."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones[:-1])]).astype(np.int32)

    def ones(self, position: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = position >> 6
        mask = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """A wavelet tree, level by level: each level keeps one bit of each symbol and then moves the zeros to the front."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        self.shifts = list(range(max(1, int(size - 1).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = (symbols >> shift) & 1
            self.levels.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.start = self.descend(np.arange(size), np.zeros(size, dtype=np.int64))

    def descend(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = bits.ones(position)
            position = np.where((symbol >> shift) & 1, zeros + ones, position - ones)
        return position

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.descend(symbol, position) - self.start[symbol]


def suffix_array(text: np.ndarray, breaks: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by doubling. The breaks (one behind each sequence, smaller than all words and distinct by their
    place) end every comparison within ``longest`` words."""
    n = len(text)
    order = np.zeros(n, dtype=np.int64)
    order[breaks] = np.arange(len(breaks))
    inner = np.ones(n, dtype=bool)
    inner[breaks] = False
    order[inner] = text[inner] + len(breaks)
    step = 1
    _, rank = np.unique(order, return_inverse=True)
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[:-step] = rank[step:] + 1
        key = rank * np.int64(n + 1) + behind
        sa = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(np.diff(key[sa]) != 0)])
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = new
        step *= 2
        if new[-1] == n - 1 or step > longest:
            return sa


class FMIndex:
    """Sequences of numbers from 1 up, each followed by a break. Searched from right to left."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray):
        self.first = np.cumsum(lengths + 1) - (lengths + 1)
        n = int((lengths + 1).sum())
        self.text = np.zeros(n, dtype=np.int64)
        breaks = self.first + lengths
        inner = np.ones(n, dtype=bool)
        inner[breaks] = False
        self.text[inner] = sequences
        self.sa = suffix_array(self.text, breaks, int(lengths.max()) + 1)
        size = int(self.text.max()) + 1
        self.tree = WaveletMatrix(self.text[self.sa - 1], size)
        counts = np.bincount(self.text, minlength=size)
        # Where the suffixes that begin with a word start, less where the tree puts its first occurrence.
        self.shift = np.cumsum(counts) - counts - self.tree.start

    def matching_statistics(self, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the words up to each place ``ends`` of the indexed text: how many of them (at most ``limit``, at least 1) also
        occur elsewhere in the index, and the interval of the suffixes that begin with them. A search stops as soon
        as only its own place is left."""
        n = len(self.text)
        length = np.zeros(len(ends), dtype=np.int64)
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), n)
        live = np.arange(len(ends))
        for k in range(limit):
            symbol = self.text[ends[live] - k]
            lo = self.shift[symbol] + self.tree.descend(symbol, low[live])
            hi = self.shift[symbol] + self.tree.descend(symbol, high[live])
            go_on = hi - lo > 1
            live = live[go_on]
            if not len(live):
                break
            low[live], high[live] = lo[go_on], hi[go_on]
            length[live] += 1
        return length, low, high
