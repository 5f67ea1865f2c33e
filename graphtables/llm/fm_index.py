"""An FM-index over integer symbols in numpy: suffix order, wavelet-tree ranks, sampled positions.

The small in-task helper of :mod:`graphtables.llm.decontam`. A shard's words are symbols from
FIRST on; SEPARATOR ends each text and the index adds the unique, smallest END.
"""

from __future__ import annotations

import numpy as np

from graphtables._workers import ship_with_tasks

END, SEPARATOR, FIRST = 0, 1, 2
#: every so many-th position of the text is kept with the suffix order
SAMPLE = 16


def _renumbered(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where a sorted (group, key) run begins."""
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    return new


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of symbols that end in their unique smallest one, in order, by
    prefix doubling.

    The first sort compares as many symbols as fit one integer; later ones sort only
    suffixes whose place is still open, by the rank of what follows their known prefix."""
    n = len(symbols)
    width = max(1, int(symbols.max(initial=0)).bit_length())
    depth = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for k in range(min(depth, n)):
        key[:n - k] |= symbols[k:] << (width * (depth - 1 - k))
    order = np.argsort(key)
    first = _renumbered(key[order], key[order])
    rank = np.empty(n, np.int64)            # of each suffix: where its group of equals begins
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        alone = first & np.append(first[1:], True)
        places = np.flatnonzero(~alone)     # of suffixes that are not in their final order
        if not len(places):
            return order
        at = order[places]
        follow = rank[at + depth]           # in range: END is unique, so its suffix is settled
        # places of a group are adjacent: sorting by (group, follow) keeps groups in place
        by = np.argsort(rank[at] * n + follow)
        at, follow = at[by], follow[by]
        group = rank[at]
        order[places] = at
        new = _renumbered(group, follow)
        first[places] = new
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        depth *= 2


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)[:-1]))
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet tree with one bit vector a level (zeros moved before ones at each)."""

    def __init__(self, symbols: np.ndarray):
        self.height = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels = []
        for level in reversed(range(self.height)):
            one = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(one)))
            symbols = np.concatenate((symbols[~one], symbols[one]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position i."""
        start, end = np.zeros_like(i), i
        for level, bits in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(end)
            start = np.where(one, bits.zeros + a, start - a)
            end = np.where(one, bits.zeros + b, end - b)
        return end - start

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at position i, its occurrences before i)."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for level, bits in self.levels:
            one = bits.get(i)
            symbol |= one.astype(np.int64) << level
            a, b = bits.rank(start), bits.rank(i)
            start = np.where(one, bits.zeros + a, start - a)
            i = np.where(one, bits.zeros + b, i - b)
        return symbol, i - start


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols, END).astype(np.int64)
        order = suffix_order(symbols)
        self.wavelet = Wavelet(symbols[order - 1])              # -1 wraps round to the end
        counts = np.bincount(symbols)
        self.starts = np.concatenate(([0], np.cumsum(counts)))  # first row of each symbol
        sampled = order % SAMPLE == 0
        self.sampled = Bits(sampled)
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases (rows of symbols, right-aligned, -1 before a
        phrase's first word; all words known) by backward search, all at once."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.starts[-1], np.int64)
        for column in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((phrases[:, column] >= 0) & (low < high))
            symbol = phrases[live, column]
            at = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live] = self.starts[symbol] + at[:len(live)]
            high[live] = self.starts[symbol] + at[len(live):]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the nearest sampled one."""
        out = np.zeros(len(rows), np.int64)
        open_, steps, rows = np.arange(len(rows)), 0, rows.copy()
        while len(open_):
            done = self.sampled.get(rows)
            out[open_[done]] = self.positions[self.sampled.rank(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            if len(open_):
                symbol, before = self.wavelet.step(rows)
                rows = self.starts[symbol] + before
            steps += 1
        return out


ship_with_tasks(__name__)
