"""Order statistics of many ranges of one row of numbers, by a wavelet matrix.

The matrix sorts the numbers stably by one bit after another, from the highest;
how many zeros stand before a place says where a range goes.  All ranges pass a
level together, so only one level is in memory: time is (numbers + ranges) times
bits, memory is linear.
"""

from __future__ import annotations

import numpy as np


def _levels(values: np.ndarray, bits: int):
    """Per bit from the highest: the bit, zeros before every place, and zeros in all."""
    now = values.astype(np.int64)
    for bit in range(bits - 1, -1, -1):
        zero = (now >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        yield bit, before, int(before[-1])
        now = np.concatenate([now[zero], now[~zero]])


def kth_smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Per range ``values[low:high]`` its element number ``k`` in order, from 0. Numbers are not negative; ``k`` lies in the range."""
    low, high, k, found = low.copy(), high.copy(), k.copy(), np.zeros(len(k), np.int64)
    for bit, before, zeros in _levels(values, max(1, int(values.max(initial=0)).bit_length())):
        a, b = before[low], before[high]
        up = k >= b - a
        k -= np.where(up, b - a, 0)
        found |= up.astype(np.int64) << bit
        low, high = np.where(up, zeros + low - a, a), np.where(up, zeros + high - b, b)
    return found


def count_less(values: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Per range ``values[low:high]`` how many are below ``bound``. Neither numbers nor bounds are negative."""
    low, high, found = low.copy(), high.copy(), np.zeros(len(bound), np.int64)
    for bit, before, zeros in _levels(values, max(int(values.max(initial=0)), int(bound.max(initial=0)), 1).bit_length()):
        a, b = before[low], before[high]
        up = (bound >> bit) & 1 == 1
        found += np.where(up, b - a, 0)
        low, high = np.where(up, zeros + low - a, a), np.where(up, zeros + high - b, b)
    return found


def frames(group: np.ndarray, at: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by group and time, the range of rows of one's group at most ``span`` away."""
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if len(group) else np.empty(0, np.int64)
    ends = np.append(first[1:], len(group))
    low, high = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    many = ends - first > 1
    low[first[~many]], high[first[~many]] = first[~many], ends[~many]
    for a, e in zip(first[many].tolist(), ends[many].tolist(), strict=True):
        t = at[a:e]
        low[a:e] = a + np.searchsorted(t, t - span, side="left")
        high[a:e] = a + np.searchsorted(t, t + span, side="right")
    return low, high
