"""Percentiles of sliding windows without sorting a window: order statistics over running counts, bit by bit of the values' ranks.

The ranks of a series are split by their highest bit, each half by the next one,
and so on; running counts of zeros tell how many values of any window go to
either side. The k-th value of every window is found at once, in as many steps as
the ranks have bits, whatever the windows' length.
"""

from __future__ import annotations

import numpy as np


class Order:
    """Order statistics of any ranges of a series."""

    def __init__(self, values: np.ndarray):
        self.values, rank = np.unique(values, return_inverse=True)
        self.zeros: list[np.ndarray] = []
        rank = rank.reshape(-1)
        for bit in reversed(range(max(1, int(len(self.values) - 1).bit_length()))):
            low = (rank >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            rank = np.concatenate([rank[low], rank[~low]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) among values[lo:hi], for arrays of ranges that have so many values."""
        rank = np.zeros(len(k), np.int64)
        for zeros in self.zeros:
            before, upto = zeros[lo], zeros[hi]
            n = upto - before
            left = k < n
            lo = np.where(left, before, zeros[-1] + lo - before)
            hi = np.where(left, upto, zeros[-1] + hi - upto)
            k = np.where(left, k, k - n)
            rank = 2 * rank + ~left
        return self.values[rank]


def range_percentiles(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, quantiles: tuple[float, ...]) -> np.ndarray:
    """Percentiles, interpolated linearly, of the known values in each range; NaN is unknown, and so is the result of a range without any."""
    known = ~np.isnan(values)
    upto = np.concatenate([[0], np.cumsum(known)])
    lo, hi = upto[lo], upto[hi]
    out = np.full((len(lo), len(quantiles)), np.nan)
    some = hi > lo
    if not some.any():
        return out
    order, lo, hi = Order(values[known]), lo[some], hi[some]
    for j, q in enumerate(quantiles):
        place = (hi - lo - 1) * q
        below, above = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
        a, b = order.kth(lo, hi, below), order.kth(lo, hi, above)
        out[some, j] = np.where(a == b, a, (above - place) * a + (place - below) * b)
    return out
