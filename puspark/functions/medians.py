"""Order statistics of many windows over one sequence, all windows at once."""

from __future__ import annotations

import numpy as np


def window_kth(values, weights, start, stop, kth):
    """For each window ``[start, stop)`` of ``values``, its ``kth`` smallest element (0-based, weights counted).

    Parallel bisection over value ranks: each pass looks at one bit of the rank, counts by prefix sums how
    much weight of every window has that bit clear, and stably regroups the sequence by the bit. Cost is
    O((sequence + windows) * log(distinct values)), independent of the window length.
    """
    levels, rank = np.unique(np.asarray(values, dtype=np.float64), return_inverse=True)
    weights = np.asarray(weights, dtype=np.int64)
    start, stop, kth = (np.array(x, dtype=np.int64) for x in (start, stop, kth))
    answer = np.zeros(len(start), dtype=np.int64)
    for bit in reversed(range(max(int(len(levels) - 1).bit_length(), 0))):
        clear = (rank >> bit) & 1 == 0
        place = np.concatenate(([0], np.cumsum(clear)))
        mass = np.concatenate(([0], np.cumsum(np.where(clear, weights, 0))))
        inside = mass[stop] - mass[start]
        low = kth < inside
        answer |= np.where(low, 0, 1 << bit)
        kth = np.where(low, kth, kth - inside)
        start = np.where(low, place[start], place[-1] + start - place[start])
        stop = np.where(low, place[stop], place[-1] + stop - place[stop])
        rank = np.concatenate((rank[clear], rank[~clear]))
        weights = np.concatenate((weights[clear], weights[~clear]))
    return levels[answer]


def to_runs(first, values):
    """Run-length encode consecutive equal values starting at position ``first``: (positions, lengths, values)."""
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    length = np.diff(np.concatenate((edge, [len(values)])))
    return first + edge, length, values[edge]
