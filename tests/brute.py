"""The valley test of one whole histogram in one place, for comparison with the distributed one."""

from __future__ import annotations

import math

import numpy as np


def moving_average(counts: np.ndarray, step: int) -> np.ndarray:
    w = len(counts)
    prefix = np.concatenate(([0], np.cumsum(counts)))
    j = np.arange(w)
    low, high = np.maximum(0, j - step), np.minimum(w - 1, j + step - 1)
    return (prefix[high + 1] - prefix[low]) / (high - low + 1)


def turning_points(m: np.ndarray, least_high: float, most_low: float) -> list[tuple[int, bool]]:
    """Maxima and minima in turn, a maximum first: the lower of minima and the higher of maxima in a row."""
    found: list[tuple[int, bool]] = []

    def put(j: int, is_max: bool) -> None:
        if found and found[-1][1] == is_max:
            if (m[j] > m[found[-1][0]]) if is_max else (m[j] < m[found[-1][0]]):
                found[-1] = (j, is_max)
        elif found or is_max:
            found.append((j, is_max))

    if len(m) > 1:
        # beyond the ends lies nothing: one neighbour decides there, and the first value may be a maximum only
        rise = np.sign(np.diff(m))
        before, after = np.concatenate(([1], rise)), np.concatenate((rise, [0]))
        before_low = np.concatenate(([0], rise))
        after_high, after_low = after.copy(), after.copy()
        after_high[-1], after_low[-1] = -1, 1
        high = (before > 0) & (after_high < 0) & (m >= least_high)
        low = (before_low < 0) & (after_low > 0) & (m <= most_low)
        for j in np.flatnonzero(high | low).tolist():
            put(j, bool(high[j]))
    return found


def squeeze_plateaus(m: np.ndarray) -> np.ndarray:
    """Runs of equal values as one value each."""
    return m[np.concatenate(([True], m[1:] != m[:-1]))]


def harmonic(n: np.ndarray) -> np.ndarray:
    """1 + 1/2 + .. + 1/n of each n >= 0 (from 64 on by the asymptotic series, to double precision)."""
    table = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, 64))))
    x = np.maximum(n, 64).astype(np.float64)
    series = np.log(x) + np.euler_gamma + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)
    return np.where(n < 64, table[np.minimum(n, 63)], series)


def bends(pos: np.ndarray, n: np.ndarray, width: int, step: int) -> tuple[np.ndarray, float]:
    """The moving average where it can turn, in order, and its mean over all positions.

    Between two positions at which a point enters or leaves the window the average has one numerator; its
    denominator is constant, or moves one way within ``step`` of an edge. So each such stretch is constant or strictly
    monotone, and its first and last values show every strict turn and the largest value. ``pos`` (sorted, from 0) are the
    occupied positions, so memory goes with these and not with the width.
    """
    total = np.concatenate(([0], np.cumsum(n)))
    starts = np.concatenate(([0, step, width - step + 1], pos - step + 1, pos + step + 1))
    starts = np.unique(starts[(starts >= 0) & (starts < width)])
    lasts = np.concatenate((starts[1:] - 1, [width - 1]))

    def window(j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.maximum(0, j - step), np.minimum(width - 1, j + step - 1)
        return total[np.searchsorted(pos, high, "right")] - total[np.searchsorted(pos, low, "left")], high - low + 1

    inside, first = window(starts)
    final = window(lasts)[1]
    least, most = np.minimum(first, final), np.maximum(first, final)
    inverse = np.where(first == final, (lasts - starts + 1) / first, harmonic(most) - harmonic(least - 1))
    at = np.unique(np.concatenate((starts, lasts)))
    held, size = window(at)
    return held / size, math.fsum((inside * inverse).tolist()) / width


def one_dimension(counts: np.ndarray, is_root: bool, share: float = 0.10, plateaus: bool = False) -> tuple[bool, bool]:
    """``occupied`` of a whole histogram."""
    pos = np.flatnonzero(counts)
    return occupied(pos, counts[pos], len(counts), is_root, share, plateaus)


def occupied(pos: np.ndarray, n: np.ndarray, w: int, is_root: bool, share: float = 0.10, plateaus: bool = False) -> tuple[bool, bool]:
    """(valley found, worth looking at further dimensions) of the sorted occupied positions in a box of width ``w``."""
    step = w // 20
    if step < 2:
        return False, False
    m, average = bends(pos, n, w, step)
    gap = max(1.0, average * share)
    if not is_root and float(m.max()) < n.sum() / w:
        return False, False
    least_high, most_low = share * average, float(m.max()) - share * average
    points = turning_points(squeeze_plateaus(m) if plateaus else m, least_high, most_low)
    values = squeeze_plateaus(m) if plateaus else m
    if len(points) < 3:
        return False, False
    top, low = 0, None
    for at, (j, is_max) in enumerate(points):
        if is_max:
            if values[j] > values[points[top][0]]:
                top = at
        elif values[j] <= values[points[top][0]] - gap:
            low = at
            break
    if low is None:
        return False, False
    bottom = values[points[low][0]]
    for j, is_max in points[low + 1 :]:
        if is_max:
            if values[j] >= bottom + gap:
                return True, False
        else:
            bottom = min(bottom, values[j])
    return False, True
