"""A full-text index of a row of symbols: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many symbols, the position of a suffix is kept.
SAMPLED = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; each 0 is an end of its own, earlier ones smaller."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    order, length = np.argsort(rank, kind="stable"), 1
    while True:
        sorted_rank = rank[order]
        new = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])]) if n else sorted_rank
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        # suffixes that agree so far are told apart by what follows ``length`` symbols later
        follows = np.zeros(n, np.int64)
        follows[: n - length] = rank[length:] + 1
        rank = rank * (n + 1) + follows
        order, length = np.argsort(rank, kind="stable"), length * 2


class FMIndex:
    """Finds rows of symbols from 1 up in a text of symbols; 0 ends each part of the text, the last too."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        order = suffix_order(symbols)
        bwt = symbols[order - 1].astype(np.int64)
        bits = max(1, int(symbols.max(initial=1)).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        # positions that can be told at once: each SAMPLED-th, and those after an end
        told = (order % SAMPLED == 0) | (bwt == 0)
        self.told, self.position = told, np.where(told, order, -1)
        self.levels = []
        for level in range(bits - 1, -1, -1):
            one = (bwt >> level & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])  # before each place
            self.levels.append((level, one, zeros))
            bwt = np.concatenate([bwt[~one], bwt[one]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transformed text."""
        first = np.zeros_like(place)
        for level, _, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            first = np.where(one, zeros[-1] + first - zeros[first], zeros[first])
            place = np.where(one, zeros[-1] + place - zeros[place], zeros[place])
        return place - first

    def symbol(self, place: np.ndarray) -> np.ndarray:
        found = np.zeros_like(place)
        for level, ones, zeros in self.levels:
            one = ones[place]
            found |= one.astype(np.int64) << level
            place = np.where(one, zeros[-1] + place - zeros[place], zeros[place])
        return found

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last suffix that begins with each phrase; phrases are rows filled up with zeros."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            (going,) = np.nonzero((lengths > step) & (high > low))
            c = phrases[going, lengths[going] - 1 - step]
            known = c < len(self.smaller) - 1
            c = np.where(known, c, 0)
            below = self.smaller[c]
            low[going] = np.where(known, below + self.rank(c, low[going]), 0)
            high[going] = np.where(known, below + self.rank(c, high[going]), 0)
        return low, high

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back in the text until a position that is kept."""
        found, place = np.full(len(suffixes), -1, np.int64), suffixes.copy()
        steps, left = 0, np.arange(len(suffixes))
        while left.size:
            done = self.told[place[left]]
            found[left[done]] = self.position[place[left[done]]] + steps
            left, steps = left[~done], steps + 1
            c = self.symbol(place[left])
            place[left] = self.smaller[c] + self.rank(c, place[left])
        return found
