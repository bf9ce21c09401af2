"""An FM-index over a shard's word sequence: suffix order, Burrows-Wheeler symbols in a wavelet tree, sampled positions.

Symbols are vocabulary numbers from 1; 0 separates. Suffixes are ordered by their first ``depth`` symbols, which is all that a phrase
of at most ``depth`` words needs; ties keep text order.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` symbols (at least), by rank doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    length = 1
    while length < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - length)] = rank[length:] + 1
        key = rank * (int(rank.max()) + 2 if n else 1) + ahead
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])[:n]
        length *= 2
        if n and rank[order[-1]] == n - 1:
            break
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit; each level keeps zeros in front (a wavelet matrix)."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.n = bits, len(sequence)
        self.counts, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.counts.append(ones)
            self.zeros.append(int(self.n - ones[-1]))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place, counted from the symbol's own block start."""
        lo, hi = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.counts[k][lo], self.counts[k][hi]
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, depth: int, sample: int = 8):
        text = np.append(text, 0).astype(np.int64)  # a last separator: the text is a cycle
        self.n, self.sample = len(text), sample
        order = suffix_order(text, depth)
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, max(1, int(symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.bwt = bwt
        kept = order % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]
        # With order by bounded depth, a step to the previous position is only known up to ties; so the rows
        # of equal bounded prefix stay together, and the step is stored where the plain rule would miss.
        self.row_of = np.empty(self.n, np.int64)
        self.row_of[order] = np.arange(self.n)
        step = self.before[bwt] + self._own_rank(bwt)
        true = self.row_of[(order - 1) % self.n]
        wrong = np.flatnonzero(step != true)
        self.fix_at, self.fix_to = wrong, true[wrong]
        del self.row_of

    @staticmethod
    def _own_rank(s: np.ndarray) -> np.ndarray:
        """For each place, how often its own symbol stands before it."""
        order = np.argsort(s, kind="stable")
        t = s[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        out = np.empty(len(s), np.int64)
        out[order] = np.arange(len(s)) - first
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [lo, hi) of each phrase (one per row, padded on the right), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(int(lengths.max()) if len(lengths) else 0):
            on = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(on):
                break
            s = phrases[on, lengths[on] - 1 - back]
            lo[on], hi[on] = self.before[s] + self.tree.rank(s, lo[on]), self.before[s] + self.tree.rank(s, hi[on])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled position, counting steps."""
        rows, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            open_ = open_[self.kept[r + 1] == self.kept[r]]
            if not len(open_):
                break
            r = rows[open_]
            s = self.bwt[r]
            to = self.before[s] + self.tree.rank(s, r)
            if len(self.fix_at):
                at = np.minimum(np.searchsorted(self.fix_at, r), len(self.fix_at) - 1)
                to = np.where(self.fix_at[at] == r, self.fix_to[at], to)
            rows[open_] = to
            steps[open_] += 1
        return self.places[self.kept[rows]] + steps
