"""An FM-index over sequences of 64-bit symbols, searched for many patterns at once.

The index holds, for one shard, the Burrows-Wheeler transform of all sequences as a
wavelet matrix of packed bit vectors with block counts, and for each place of the
suffix order the first place of its group of suffixes that share ``depth`` symbols.
Patterns are read from right to left, all in step; after ``depth`` symbols the interval
is widened to that group after each step, so that it always stands for the
``depth`` symbols that start at the current place: one backward step a place.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with counts up to each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.bits = max(int(sigma - 1).bit_length(), 1)
        now = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = ((now >> b) & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _walk(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.rank(at)
            at = np.where((c >> (self.bits - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before each place."""
        return self._walk(c, at) - self.start[c]


class FMIndex:
    def __init__(self, sequences: list[np.ndarray], depth: int):
        """Sequences of 64-bit symbols; ``depth`` symbols make a match."""
        self.depth = depth
        lengths = np.array([len(s) for s in sequences])
        flat = np.concatenate(sequences)
        _, dense = np.unique(flat, return_inverse=True)
        ends = np.cumsum(lengths)
        n = len(flat) + len(sequences)
        self.text = np.zeros(n, dtype=np.int64)             # 0 ends each sequence
        place = np.arange(len(flat)) + np.repeat(np.arange(len(sequences)), lengths)
        self.text[place] = dense.ravel() + 1
        self.first = ends - lengths + np.arange(len(sequences))
        self.lengths = lengths
        sigma = int(self.text.max()) + 1

        # suffixes in order of at least their first depth + 1 symbols, by doubling
        rank, reach, at_depth = self.text.copy(), 1, None
        while reach <= depth:
            if 2 * reach > depth and at_depth is None:      # two overlapping runs make depth symbols
                at_depth = (rank, depth - reach)
            shifted = np.zeros(n, dtype=np.int64)
            shifted[:n - reach] = rank[reach:] + 1
            pairs = rank * (int(rank.max()) + 2) + shifted
            order = np.argsort(pairs, kind="stable")
            new = np.empty(n, dtype=np.int64)
            new[order] = np.cumsum(np.concatenate([[False], pairs[order][1:] != pairs[order][:-1]]))
            rank, reach = new, 2 * reach
        self.order = order
        base, step = at_depth
        later = np.full(n, -1, dtype=np.int64)
        later[:n - step] = base[step:]
        a, b = base[order], later[order]
        new_group = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.group = np.cumsum(new_group) - 1
        self.starts = np.append(np.flatnonzero(new_group), n)

        self.less = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=sigma))])
        self.bwt = WaveletMatrix(self.text[order - 1], sigma)

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each group of suffixes, the least value of the sequences they stand in."""
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)
        return np.minimum.reduceat(values[owner[self.order]], self.starts[:-1])

    def matches(self, which: np.ndarray | None = None):
        """Stream sequences through the index: yields (sequences, place in each, group of the
        suffixes that start with the ``depth`` symbols there), from right to left."""
        which = np.arange(len(self.lengths)) if which is None else which
        which = which[np.argsort(-self.lengths[which], kind="stable")]
        lengths, first = self.lengths[which], self.first[which]
        lo = np.zeros(len(which), dtype=np.int64)
        hi = np.full(len(which), len(self.text), dtype=np.int64)
        for t in range(int(lengths.max()) if len(which) else 0):
            live = int(np.searchsorted(-lengths, -t, side="left"))      # sequences longer than t
            which, lengths, first, lo, hi = which[:live], lengths[:live], first[:live], lo[:live], hi[:live]
            c = self.text[first + lengths - 1 - t]
            lo = self.less[c] + self.bwt.rank(c, lo)
            hi = self.less[c] + self.bwt.rank(c, hi)
            if t + 1 >= self.depth:
                group = self.group[lo]
                lo, hi = self.starts[group], self.starts[group + 1]
                yield which, lengths - 1 - t, group
