"""Exact arithmetic over integer sufficient statistics, on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence


def safe_div(a: float, b: float) -> float:
    """IEEE division: infinities and NaN instead of an exception."""
    if b:
        return a / b
    if a == 0 or a != a:
        return math.nan
    return math.copysign(math.inf, a) * math.copysign(1.0, b)


def ssq_by_dim(n: int, ls: Sequence[int], ss: Sequence[int]) -> list[float]:
    """Sum of squared deviations per dimension; exactly 0 for coincident points."""
    return [(n * q - s * s) / n if n else 0.0 for s, q in zip(ls, ss)]


def ssq(n: int, ls: Sequence[int], ss: Sequence[int]) -> float:
    return sum(n * q - s * s for s, q in zip(ls, ss)) / n if n else 0.0


def centroid(n: int, ls: Sequence[int]) -> list[float]:
    return [s / n for s in ls]


def radii(n: int, ls: Sequence[int], ss: Sequence[int]) -> list[float]:
    """Population standard deviation per dimension."""
    return [math.sqrt(x / n) for x in ssq_by_dim(n, ls, ss)]


def global_radius(n: int, ls: Sequence[int], ss: Sequence[int]) -> float:
    return math.sqrt(ssq(n, ls, ss) / n)


def gain(n1: int, ls1: Sequence[int], n2: int, ls2: Sequence[int]) -> float:
    """SSQ removed by parting two sets, or added by joining them."""
    if not n1 * n2:
        return 0.0
    return n1 * n2 / (n1 + n2) * sum((a / n1 - b / n2) ** 2 for a, b in zip(ls1, ls2))


def calinski_harabasz(between: float, within: float, n: int, k: int) -> float:
    return safe_div(between * (n - k), within * (k - 1))


def log_volume(inf: Sequence[int], sup: Sequence[int]) -> float:
    """Logarithm of the number of integer points in a box: no overflow in many dimensions."""
    return sum(math.log(b - a + 1) for a, b in zip(inf, sup))


def volume(inf: Sequence[int], sup: Sequence[int]) -> float:
    out = 1.0
    for a, b in zip(inf, sup):
        out *= b - a + 1
    return out
