"""Geometry as column expressions: everything stays inside code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def elliptical(cols: Sequence[str], center: Sequence[float], rho: Sequence[float], zero_radius: str = "exact") -> Column:
    """Sum of squared deviations in units of the ellipse's half axes; inside at 1 or less.

    A dimension of zero radius asks for the very coordinate (``exact``) or does not count
    (``ignore``).
    """
    parts, conditions = [], []
    for c, m, r in zip(cols, center, rho):
        if r > 0:
            d = (F.lit(float(m)) - F.col(c)) / F.lit(float(r))
            parts.append(d * d)
        elif zero_radius == "exact":
            conditions.append(F.col(c) == F.lit(float(m)))
    value = total(parts) if parts else F.lit(0.0)
    return F.when(reduce(lambda a, b: a & b, conditions), value).otherwise(F.lit(float("inf"))) if conditions else value


def with_nearest(df: DataFrame, label: str, distances: Sequence[tuple[int, Column]], missing: int | None = None) -> DataFrame:
    """Index of the least distance of at most 1 (the first listed on ties), or ``missing``.

    Distances are columns of their own before they are compared, so that the generated code
    stays linear in the number of clusters.
    """
    if not distances:
        return df.withColumn(label, F.lit(missing).cast("int"))
    names = [f"_distance_{i}" for i, _ in distances]
    rows = df.withColumns({name: d for name, (_, d) in zip(names, distances)})
    low = F.least(*names) if len(names) > 1 else F.col(names[0])
    rows = rows.withColumn("_distance_low", low)
    which = F.coalesce(*[F.when(F.col(name) == F.col("_distance_low"), F.lit(i)) for name, (i, _) in zip(names, distances)])
    return rows.withColumn(label, F.when(F.col("_distance_low") <= 1, which).otherwise(F.lit(missing)).cast("int")).drop(*names, "_distance_low")


def constants(values: Iterable, kind: str) -> Column:
    """A constant array, as one literal in the plan whatever its length."""
    text = ",".join(map(repr, values))
    return (F.split(F.lit(text), ",") if text else F.array()).cast(f"array<{kind}>")


@dataclass
class Grid:
    """Ellipses by the cells of a grid over two dimensions that their boxes touch: ``ids`` from ``starts[cell]`` on.

    Cell 0 is the outside. The grid is as fine as ``entries`` allow.
    """

    dims: tuple[int, ...]
    low: list[float]
    step: list[float]
    cells: list[int]
    starts: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray, entries: int = 1 << 18, side: int = 256) -> Grid:
        """Of the boxes from ``low`` to ``high`` (ellipses by dimensions)."""
        # the dimensions in which the boxes cover least of the whole, one another's beginnings apart
        span = high.max(0) - low.min(0)
        cover = np.where(span > 0, (high - low).mean(0) / np.where(span > 0, span, 1), 1.0)
        dims = tuple(int(i) for i in np.argsort(cover, kind="stable")[:2])
        base, span = low.min(0)[list(dims)], span[list(dims)]
        while True:
            step = np.where(span > 0, span / side, 1.0)
            first = np.clip(np.floor((low[:, dims] - base) / step), 0, side - 1).astype(np.int64)
            last = np.clip(np.floor((high[:, dims] - base) / step), 0, side - 1).astype(np.int64)
            # a rounding error may put a border into the cell beside its own
            first, last = np.maximum(first - 1, 0), np.minimum(last + 1, side - 1)
            wide = last - first + 1
            if side == 1 or int(wide.prod(1).sum()) <= entries:
                break
            side //= 2
        which, at = np.arange(len(low)), np.zeros(len(low), np.int64)
        for k in range(len(dims)):
            each = wide[which, k]
            inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            which, at = np.repeat(which, each), np.repeat(at, each) * side
            at = at + first[which, k] + inner
        order = np.lexsort((which, at))
        starts = np.searchsorted(at[order], np.arange(side ** len(dims) + 1))
        return cls(dims, base.tolist(), step.tolist(), [side] * len(dims), starts, which[order])

    def cell(self, cols: Sequence[str]) -> Column:
        """Number of a point's cell from 1, or null outside the grid."""
        out, within = F.lit(0), F.lit(True)
        for i, low, step, side in zip(self.dims, self.low, self.step, self.cells):
            at = F.floor((F.col(cols[i]) - F.lit(low)) / F.lit(step))
            # the highest border belongs to the last cell, and rounding may put a point there or just before the first
            within = within & at.between(-1, side)
            out = out * side + F.greatest(F.lit(0), F.least(at, F.lit(side - 1))).cast("int")
        return F.when(within, out + 1)

    def candidates(self, cols: Sequence[str]) -> tuple[Column, Column, Column]:
        """A point's cell, and the lists by cell as ``with_candidates`` takes them."""
        return self.cell(cols), constants(self.starts.tolist(), "int"), constants(self.ids.tolist(), "int")


def with_candidates(
    df: DataFrame, label: str, cols: Sequence[str], place: Column, starts: Column, ids: Column, centers: Sequence[Sequence[float]], rhos: Sequence[Sequence[float]], zero_radius: str = "exact", missing: int | None = None
) -> DataFrame:
    """``nearest_of`` the candidates that ``ids`` list from ``starts[place]`` to ``starts[place + 1]``, or ``missing``; a null place has none.

    Each step is a column of its own, so that none is computed more than once.
    """
    rows = df.withColumn("_place", place)
    rows = rows.withColumns({"_from": F.element_at(starts, F.col("_place")), "_to": F.element_at(starts, F.col("_place") + 1)})
    rows = rows.withColumn("_listed", F.slice(ids, F.col("_from") + 1, F.col("_to") - F.col("_from")))
    rows = rows.withColumn(label, nearest_of(cols, F.col("_listed"), centers, rhos, zero_radius))
    return (rows if missing is None else rows.withColumn(label, F.coalesce(label, F.lit(missing)))).drop("_place", "_from", "_to", "_listed")


def nearest_of(cols: Sequence[str], candidates: Column, centers: Sequence[Sequence[float]], rhos: Sequence[Sequence[float]], zero_radius: str = "exact") -> Column:
    """The candidate (a number into the lists) of least elliptical distance of at most 1, the lowest on ties, or null."""
    flat = [(constants([float(c[i]) for c in centers], "double"), constants([float(r[i]) for r in rhos], "double")) for i in range(len(cols))]

    def distance(k: Column) -> Column:
        parts, right = [], F.lit(True)
        for c, (center, rho) in zip(cols, flat):
            m, r = F.element_at(center, k + 1), F.element_at(rho, k + 1)
            d = (m - F.col(c)) / F.when(r > 0, r)
            parts.append(F.coalesce(d * d, F.lit(0.0)))
            right = right & ((r > 0) | (F.col(c) == m))
        value = total(parts)
        return F.when(right, value).otherwise(F.lit(float("inf"))) if zero_radius == "exact" else value

    near = F.filter(F.transform(candidates, lambda k: F.struct(distance(k).alias("d"), k.alias("k"))), lambda s: s["d"] <= 1)
    return F.array_min(near)["k"]


def inside(cols: Sequence[str], inf: Sequence[int], sup: Sequence[int]) -> Column:
    """Box membership, both ends included."""
    return reduce(lambda a, b: a & b, [F.col(c).between(int(a), int(b)) for c, a, b in zip(cols, inf, sup)])


def holds_box(inf: Sequence[int], sup: Sequence[int], other_inf: Sequence[Column], other_sup: Sequence[Column]) -> Column:
    """Whether a fixed box holds another one."""
    return reduce(lambda a, b: a & b, [(F.lit(int(i)) <= x) & (y <= F.lit(int(s))) for i, s, x, y in zip(inf, sup, other_inf, other_sup)])


def restricted_bounds(center: Column, inf: Column, sup: Column) -> tuple[Column, Column]:
    """One dimension of the middle of a box, as ``refine.restricted_box`` has it."""
    w = F.greatest(F.lit(1), ((sup - inf + 1) * F.lit(0.1) + F.lit(0.5)).cast("int"))
    return F.greatest(inf, (center - w).cast("int")), F.least(sup, (center + w).cast("int"))


def width(inf: Column, sup: Column) -> Column:
    return sup.cast("bigint") - inf + 1


def middle(inf: Column, sup: Column) -> Column:
    return (inf.cast("double") + sup) / 2


def random_point(inf: Sequence[Column], sup: Sequence[Column], seed: int = 42) -> list[Column]:
    """A point inside each box, every position alike."""
    return [(i + F.floor(F.rand(seed + k) * width(i, s))).cast("int") for k, (i, s) in enumerate(zip(inf, sup))]


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return total([(x - y) * (x - y) for x, y in zip(a, b)])


def euclidean(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(squared_distance(a, b))


def array_add(total_: Column, point: Column, weight: Column | float = 1) -> Column:
    """Vectors added, the second ``weight`` times."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.zip_with(total_, point, lambda s, x: s + w * x)


def array_add_square(total_: Column, point: Column, weight: Column | float = 1) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.zip_with(total_, point, lambda s, x: s + w * x * x)


def array_multiply(point: Column, factor: Column | float) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return F.transform(point, lambda x: x * f)


def box_volume(inf: Sequence[Column], sup: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a * b, [(s - i + 1).cast("double") for i, s in zip(inf, sup)])
