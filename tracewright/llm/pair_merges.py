"""Pair merging for many words at once: every word's agenda of adjacent pairs is a column of a matrix.

A word's symbols stand in a column, linked to their neighbours. Each symbol that can merge with its
right neighbour has an order key there (the pair's rank, then its place), any other a key beyond all.
A step takes every word's least key, merges that pair, and renews the two keys that it touches, until
no word has a key. That is the order of a priority queue of adjacent pairs with ties to the left, for
all words of a batch in as many steps as the longest one needs.
"""

from __future__ import annotations

import numpy as np

#: Words of more symbols are left to the caller, as steps and columns grow with the longest word.
LONGEST = 64
_PLACE_BITS = 6
_NEVER = np.int32(np.iinfo(np.int32).max)
#: Symbols that a matrix holds at most; more words are merged one matrix after another.
CELLS = 1 << 20


class PairTable:
    """What each pair of symbols merges into, and its rank: an open hash table in numpy arrays."""

    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, into: np.ndarray, n_symbols: int):
        if len(rank) and int(rank.max()) >= 1 << (31 - _PLACE_BITS):
            raise ValueError("too many ranks")
        self.none = n_symbols  # stands beyond either end of a word; merges with nothing
        self.wide = np.int64(n_symbols + 1)
        bits = max(8, (4 * len(left)).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.size, -1, np.int64)
        self.ranks, self.into = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        key = left.astype(np.int64) * self.wide + right
        slot, todo = self._slots(key), np.arange(len(key))
        while len(todo):  # of pairs that want one free slot the last is put there, the rest go on to the next slot
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = key[free]
            put = free[self.keys[slot[free]] == key[free]]
            self.ranks[slot[put]], self.into[slot[put]] = rank[put], into[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) % self.size

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * self._SPREAD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for a pair that does not merge."""
        key = left.astype(np.int64) * self.wide + right
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.where(there == key, slot, -1)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % self.size
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (there >= 0)]
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all words one after another, and how many each has; no word is longer than ``LONGEST``."""
        if len(lengths) and int(lengths.max()) > LONGEST:
            raise ValueError("a word is too long")
        starts = np.cumsum(lengths) - lengths
        out, alive = symbols.astype(np.int32), np.ones(len(symbols), bool)
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 2))
        while at < len(order):
            # Words of like length share a matrix, which is as high as its longest word.
            high = min(LONGEST, int(lengths[order[at]]) * 5 // 4 + 1)
            end = min(int(np.searchsorted(lengths[order], high, side="right")), at + max(1, CELLS // high))
            some = order[at:end]
            self._merge_some(out, alive, starts[some], lengths[some])
            at = end
        counts = np.add.reduceat(np.concatenate([alive, [False]]).astype(np.int64), np.minimum(starts, len(alive))) if len(starts) else lengths
        return out[alive], np.where(lengths > 0, counts, 0)

    def _merge_some(self, out: np.ndarray, alive: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        n, high = len(starts), int(lengths.max())
        place = np.arange(high)[:, None]
        inside = place < lengths
        source = np.where(inside, starts + place, 0)
        symbol = np.full((high + 1) * n, self.none, np.int32)  # row high: beyond the ends
        symbol[: high * n] = np.where(inside, out[source], self.none).reshape(-1)
        after = np.repeat(np.arange(1, high + 2, dtype=np.int32), n)
        after[(high - 1) * n :] = high
        before = np.repeat(np.arange(-1, high, dtype=np.int32), n)
        before[:n] = high
        into = np.zeros((high + 1) * n, np.int32)
        keys = np.full((high + 1, n), _NEVER, np.int32)
        flat = keys.reshape(-1)

        def renew(cell: np.ndarray, row: np.ndarray, right: np.ndarray) -> None:
            slot = self.find(symbol[cell], symbol[right])
            hit = slot >= 0
            flat[cell] = np.where(hit, (self.ranks[slot] << _PLACE_BITS) | row, _NEVER)
            into[cell[hit]] = self.into[slot[hit]]

        first = np.flatnonzero((place < lengths - 1).reshape(-1))
        renew(first, (first // n).astype(np.int32), first + n)
        while True:
            least = keys.min(axis=0)
            word = np.flatnonzero(least != _NEVER)
            if not len(word):
                break
            row = least[word] & ((1 << _PLACE_BITS) - 1)
            cell = row.astype(np.int64) * n + word
            gone = after[cell].astype(np.int64) * n + word
            follow = after[gone]
            right = follow.astype(np.int64) * n + word
            symbol[cell], symbol[gone] = into[cell], -1
            flat[gone] = _NEVER
            after[cell] = follow
            before[right] = row
            lead = before[cell]
            left = lead.astype(np.int64) * n + word
            renew(np.concatenate([cell, left]), np.concatenate([row, lead]), np.concatenate([right, cell]))
        merged = symbol[: high * n].reshape(high, n)
        out[source[inside]] = merged[inside]
        alive[source[inside]] = merged[inside] >= 0
