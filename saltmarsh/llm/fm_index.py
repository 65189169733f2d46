"""FM-index over a sequence of small integers, worked on in batches with numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence whose last symbol is smaller than all others.

    Prefix doubling; each round sorts only the suffixes that still share their prefix with another.
    """
    n = len(symbols)
    array = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)

    def place(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Give suffixes at ``at`` (places in the array, sorted by key) their ranks; the places still shared."""
        new = np.r_[True, keys[1:] != keys[:-1]]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(keys)))
        rank[array[at]] = np.repeat(at[starts], sizes)
        return at[np.repeat(sizes, sizes) > 1]

    open_places = place(np.arange(n), symbols[array])
    width = 1
    while len(open_places):
        suffixes = array[open_places]
        # suffixes that share `width` symbols cannot contain the last symbol there, so the index stays inside
        keys = rank[suffixes] * n + rank[suffixes + width]
        order = np.argsort(keys, kind="stable")
        array[open_places] = suffixes[order]
        open_places = place(open_places, keys[order])
        width *= 2
    return array


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros((self.size // 64 + 1) * 64, np.uint8)
        padded[: self.size] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Ranks of symbols: one bit vector per level, zeros led to the left and ones to the right."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.start = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(at)
            right = symbol >> (self.depth - 1 - level) & 1
            at = np.where(right == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._descend(symbol, at) - self.start[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at)
            ones = bits.ones(at)
            symbol = symbol << 1 | one
            at = np.where(one == 1, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Finds all places of phrases in ``symbols`` (values from 1 to ``n_symbols`` - 1)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 8):
        text = np.append(symbols.astype(np.int64), 0)
        array = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[array - 1], n_symbols)
        counts = np.bincount(text, minlength=n_symbols)
        self.smaller = np.r_[0, np.cumsum(counts)[:-1]]
        self.sampled = BitVector((array % sample == 0).astype(np.uint8))
        self.samples = array[array % sample == 0]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once; the range of suffixes that begin with each (empty: none).

        ``phrases`` has one row per phrase, filled on the left, so that the last column is a phrase's end.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text places of all suffixes in the ranges: phrase numbers and places."""
        found = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(low)), found)
        row = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
        place = np.full(len(row), -1, np.int64)
        todo = np.arange(len(row))
        steps = 0
        while len(todo):
            known = self.sampled.get(row[todo]) == 1
            done = todo[known]
            place[done] = self.samples[self.sampled.ones(row[done])] + steps
            todo = todo[~known]
            symbol, rank = self.tree.symbol_and_rank(row[todo])
            row[todo] = self.smaller[symbol] + rank
            steps += 1
        return phrase, place
