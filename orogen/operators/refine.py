"""Outlier blocks, reachability and merging: decisions over a few blocks, on the driver."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import count
from statistics import fmean, pstdev

import numpy as np

from orogen.functions import exact


@dataclass
class Summary:
    """Sufficient statistics of a set of points."""

    n: int
    ls: tuple[int, ...]
    ss: tuple[int, ...]
    id: int = 0

    @property
    def ssq(self) -> float:
        return exact.ssq(self.n, self.ls, self.ss)

    @property
    def centroid(self) -> list[float]:
        return exact.centroid(self.n, self.ls)

    @property
    def radii(self) -> list[float]:
        return exact.radii(self.n, self.ls, self.ss)

    @property
    def radius(self) -> float:
        return exact.global_radius(self.n, self.ls, self.ss)

    def plus(self, other: Summary, id: int = 0) -> Summary:
        return Summary(self.n + other.n, tuple(map(sum, zip(self.ls, other.ls))), tuple(map(sum, zip(self.ss, other.ss))), id)

    def minus(self, other: Summary, id: int = 0) -> Summary:
        return Summary(self.n - other.n, tuple(a - b for a, b in zip(self.ls, other.ls)), tuple(a - b for a, b in zip(self.ss, other.ss)), id)


@dataclass
class Block:
    """A box of the binary space partition with the summary of its points."""

    id: int
    summary: Summary
    inf: tuple[int, ...]
    sup: tuple[int, ...]
    parent: int | None = None
    dim: int | None = None
    pos: int | None = None
    children: tuple[int, int] | None = None
    is_outlier: bool = False
    best: dict | None = field(default=None, repr=False)
    marks: list | None = field(default=None, repr=False)

    @property
    def density(self) -> float:
        return self.summary.n / exact.volume(self.inf, self.sup)

    @property
    def log_density(self) -> float:
        return math.log(self.summary.n) - exact.log_volume(self.inf, self.sup)


def jump_index(values: Sequence[float]) -> int:
    """Index before the first jump of sorted values whose ratio passes mean plus deviation, else the last."""
    ratios = [exact.safe_div(b, a) for a, b in zip(values, values[1:])]
    if not ratios:
        return 0
    if any(not math.isfinite(r) for r in ratios):
        return next((i for i, r in enumerate(ratios) if not math.isfinite(r)), len(ratios))
    limit = fmean(ratios) + pstdev(ratios)
    return next((i for i, r in enumerate(ratios) if r > limit), len(ratios))


def restricted_box(block: Block) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The middle of a block: a tenth of its width to either side of the centroid, one at least."""
    inf, sup = [], []
    for c, a, b in zip(block.summary.centroid, block.inf, block.sup):
        w = max(1, int((b - a + 1) * 0.1 + 0.5))
        sup.append(min(b, int(c + w)))
        inf.append(max(a, int(c - w)))
    return tuple(inf), tuple(sup)


def distance(center: Sequence[float], rho: Sequence[float], point: Sequence[float], zero_radius: str = "exact") -> float:
    out = 0.0
    for c, r, p in zip(center, rho, point):
        if r > 0:
            out += ((c - p) / r) ** 2
        elif zero_radius == "exact" and c != p:
            return math.inf
    return out


def overlaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each interval the numbers of the others that meet it, by one sweep over the sorted ends."""
    begin, end = np.argsort(other_low, kind="stable"), np.argsort(other_high, kind="stable")
    starts, open_, i, j = other_low[begin], {}, 0, 0
    for k in np.argsort(low, kind="stable").tolist():
        while i < len(begin) and starts[i] <= low[k]:
            open_[int(begin[i])] = True
            i += 1
        while j < len(end) and other_high[end[j]] < low[k]:
            open_.pop(int(end[j]), None)
            j += 1
        # those that are open where it begins, and those that begin before it ends
        later = begin[i : np.searchsorted(starts, high[k], "right")]
        yield k, np.concatenate((np.fromiter(open_, np.int64, len(open_)), later[other_high[later] >= low[k]]))


def ellipse_boxes(centers: np.ndarray, rhos: np.ndarray, zero_radius: str = "exact") -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates within each ellipse, a little more for rounding; unbounded where a radius of zero does not count."""
    more = 1e-9 * (np.abs(centers) + rhos)
    low, high = centers - rhos - more, centers + rhos + more
    if zero_radius == "ignore":
        low, high = np.where(rhos > 0, low, -float(1 << 31)), np.where(rhos > 0, high, float(1 << 31))
    return low, high


def reachability(blocks: Sequence[Block], multiplier: float = 3.0, zero_radius: str = "exact") -> dict[int, set[int]]:
    """For each block, the clusters (blocks that are no outliers) whose ellipse reaches into its box.

    Only pairs whose boxes meet in one dimension, the one in which boxes cover least, come to the exact test.
    """
    models = [b for b in blocks if not b.is_outlier]
    out = {b.id: set() if b.is_outlier else {b.id} for b in blocks}
    if not models:
        return out
    centers, rhos = np.array([b.summary.centroid for b in models], np.float64), multiplier * np.array([b.summary.radii for b in models], np.float64)
    inf, sup = np.array([b.inf for b in blocks], np.float64), np.array([b.sup for b in blocks], np.float64)
    low, high = ellipse_boxes(centers, rhos, zero_radius)
    span = np.maximum(high.max(0), sup.max(0)) - np.minimum(low.min(0), inf.min(0))
    dim = int(np.argmin(((high - low).mean(0) + (sup - inf).mean(0) + 1) / (span + 1)))
    for k, at in overlaps(inf[:, dim], sup[:, dim], low[:, dim], high[:, dim]):
        apart, rho, d = centers[at] - np.clip(centers[at], inf[k], sup[k]), rhos[at], np.zeros(len(at))
        for x, r in zip(apart.T, rho.T):
            part = np.divide(x, r, out=np.zeros(len(x)), where=r > 0)
            d += np.where((r > 0) | (x == 0) | (zero_radius == "ignore"), part * part, np.inf)
        out[blocks[k].id].update(models[i].id for i in at[d <= 1].tolist())
    return out


def admissible(a: Summary, b: Summary) -> bool:
    """No dimension of the union may spread beyond twice the sum of the two radii."""
    joint, limit = a.plus(b), 2 * (a.radius + b.radius)
    return all(r <= limit for r in joint.radii)


def merge_cost(a: Summary, b: Summary) -> float:
    """SSQ added by joining two sets."""
    out = 0.0
    for x, y in zip(a.centroid, b.centroid):
        out += (x - y) * (x - y)
    return float(a.n) * float(b.n) / (float(a.n) + float(b.n)) * out


class Partners:
    """For each living summary the cheapest admissible partner of larger id, filled when it is asked for: one entry each, not one for each pair."""

    def __init__(self, summaries: Sequence[Summary]):
        d, self.size = len(summaries[0].ls), 0
        room = 2 * len(summaries)
        self.n, self.radius, self.id = np.zeros(room), np.zeros(room), np.zeros(room, np.int64)
        self.center, self.ssq = np.zeros((room, d)), np.zeros((room, d))
        self.alive = np.zeros(room, bool)
        self.row: dict[int, int] = {}
        self.live: dict[int, Summary] = {}
        self.heap: list[tuple[float, int, int]] = []
        self.best: dict[int, tuple[float, int, int]] = {}
        for s in sorted(summaries, key=lambda s: s.id):
            self._add(s)
        for i in list(self.live):
            self._find(i)

    def _add(self, s: Summary) -> None:
        at = self.row[s.id] = self.size
        self.size += 1
        self.n[at], self.radius[at], self.id[at], self.center[at], self.ssq[at], self.alive[at] = s.n, s.radius, s.id, s.centroid, exact.ssq_by_dim(s.n, s.ls, s.ss), True
        self.live[s.id] = s

    def _costs(self, at: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of living partners between two rows that may be admissible, and their costs."""
        rows = np.flatnonzero(self.alive[low:high]) + low
        n = self.n[rows] + self.n[at]
        factor, out, widest = self.n[rows] * self.n[at] / n, np.zeros(len(rows)), np.zeros(len(rows))
        for i in range(self.center.shape[1]):
            d = self.center[rows, i] - self.center[at, i]
            out += d * d
            widest = np.maximum(widest, (self.ssq[rows, i] + self.ssq[at, i] + factor * d * d) / n)
        # what is near the limit is left to the exact test
        keep = np.sqrt(widest) <= 2 * (self.radius[rows] + self.radius[at]) * (1 + 1e-6) + 1e-9
        return rows[keep], (factor * out)[keep]

    def _list(self, entry: tuple[float, int, int]) -> None:
        self.best[entry[1]] = entry
        heapq.heappush(self.heap, entry)
        if len(self.heap) > 4 * len(self.live) + 64:
            self.heap = [e for i, e in self.best.items() if i in self.live]
            heapq.heapify(self.heap)

    def _find(self, i: int) -> None:
        at = self.row[i]
        rows, costs = self._costs(at, at + 1, self.size)
        for k in np.lexsort((rows, costs)).tolist():
            j = int(self.id[rows[k]])
            if admissible(self.live[i], self.live[j]):
                self._list((float(costs[k]), i, j))
                return
        self.best.pop(i, None)

    def cheapest(self) -> tuple[float, int, int] | None:
        """The cheapest admissible pair of living summaries."""
        while self.heap:
            entry = self.heap[0]
            _, i, j = entry
            if i in self.live and j in self.live:
                return entry
            heapq.heappop(self.heap)
            if i in self.live and self.best.get(i) == entry:
                self._find(i)
        return None

    def join(self, i: int, j: int, id: int) -> Summary:
        """Replace two summaries by their union."""
        made = self.live[i].plus(self.live[j], id)
        for x in (i, j):
            self.alive[self.row[x]] = False
            del self.live[x]
            self.best.pop(x, None)
        self._add(made)
        at = self.row[id]
        for k, cost in zip(*(x.tolist() for x in self._costs(at, 0, at))):
            # a pair dearer than its list's entry is found when that entry goes
            entry = (cost, int(self.id[k]), id)
            if entry < self.best.get(entry[1], (math.inf,)) and admissible(self.live[entry[1]], made):
                self._list(entry)
        return made


def merge(summaries: Sequence[Summary], multiplier: float = 0.9) -> tuple[list[Summary], list[dict]]:
    """Cheapest admissible merges while the index stays high; the prefix with the best index is kept.

    Pairs are of living summaries only and each occurs once, so no point counts twice.
    """
    k, n = len(summaries), sum(s.n for s in summaries)
    if k <= 2:
        return list(summaries), []
    whole = summaries[0]
    for s in summaries[1:]:
        whole = whole.plus(s)
    within = sum(s.ssq for s in summaries)
    between = whole.ssq - within
    best = initial = exact.calinski_harabasz(between, within, n, k)
    pairs = Partners(summaries)
    ids, steps, highest = count(max(pairs.live) + 1), [], initial
    while k > 2 and (top := pairs.cheapest()):
        cost, i, j = top
        index = exact.calinski_harabasz(between - cost, within + cost, n, k - 1)
        if not index > highest * multiplier:
            break
        made = pairs.join(i, j, next(ids))
        between, within, k, highest = between - cost, within + cost, k - 1, max(highest, index)
        steps.append({"step": len(steps) + 1, "left": i, "right": j, "made": made, "cost": cost, "index": index, "clusters": k})
    keep = 0
    for s in steps:
        if s["index"] > best:
            best, keep = s["index"], s["step"]
    out = {s.id: s for s in summaries}
    for s in steps[:keep]:
        del out[s["left"]], out[s["right"]]
        out[s["made"].id] = s["made"]
    return list(out.values()), [s | {"kept": s["step"] <= keep} for s in steps]
