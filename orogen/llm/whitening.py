"""Whitening of embeddings: principal components over all distinct vectors, by a randomised range finder.

1. Components of the vectors become whole numbers, floor(scale * c); rows with a null vector, or a null or
   non-finite entry, go. Every distinct vector is fitted once: the distinct ones go to the
   shared folder.
2. One pass sums each dimension exactly (two halves of 64 bits); rows are then centred by the
   exact mean before anything is multiplied.
3. A random basis of ``components + oversampling`` directions is multiplied by the covariance in
   repeated passes over all centred rows: tasks add up their rows' part, one row for each dimension, and an
   exchange by dimension adds the tasks' rows as a stream. Only matrices of the vectors' width reach the driver.
4. Each pass also gives the Rayleigh-Ritz pairs of its basis and their residuals. If after ``passes`` the residuals
   aren't at rounding level, the basis becomes the full dimension: one more pass has the covariance itself,
   whose eigenvectors the same Rayleigh-Ritz step gives.
5. A last pass takes the covariance of the whitened rows, whose distance from the identity is returned.

Cases: shorter vectors are filled up with zeros to the longest; components without variance (eigenvalue at rounding
level) are left out, so identical vectors, a single one, or an empty table give no rows; null ids and repeated
rows keep their rows; other columns are not read. Entries beyond 2 ** 63 / scale count as the largest whole number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.shared import arrow_map, materialise

#: Rows that are multiplied at a time.
ROWS = 4096
RESULT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Mean:
    """The exact mean of whole-number vectors: sums ``s`` of ``n`` vectors, entries up to ``most``."""

    n: int
    s: list[int]
    most: int

    def __post_init__(self) -> None:
        self.floor = np.array([s // self.n for s in self.s], dtype=np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.s])
        #: whether n * x - s and the sum of its squares hold in 64 bits
        self.narrow = len(self.s) * (2 * self.n * max(1, self.most)) ** 2 < 1 << 63

    def centre(self, x: np.ndarray) -> np.ndarray:
        if self.most >= 1 << 62:
            return x.astype(np.float64) - self.floor - self.rest
        return (x - self.floor).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - s) ** 2, exactly."""
        if self.narrow:
            v = x * self.n - np.array(self.s)
            return pa.array((v * v).sum(1)).cast(pa.decimal128(38, 0))
        v = x.astype(object) * self.n - np.array(self.s, dtype=object)
        return pa.array((v * v).sum(1).tolist(), pa.decimal128(38, 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS):
            batch = whole.slice(low, ROWS)
            yield batch, _matrix(batch.column(at), width)


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, x`` of the rows whose vectors are sound."""
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    sound = F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("vec", lambda c: F.floor(c * float(scale)).cast("bigint")).alias("x"))


def filled(rows: DataFrame, width: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", zeros)).otherwise(F.col("x")))


def mean(fit: DataFrame, width: int) -> Mean:
    """Exact sums over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n, most = np.zeros(width, np.int64), np.zeros(width, np.int64), 0, 0
        for _, x in _blocks(batches, 0, width):
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            most = max(most, int(x.max()), -int(x.min()))
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(high), pa.array(low), pa.array([n] * width), pa.array([min(most, (1 << 63) - 1)] * width)], names=["dim", "high", "low", "n", "most"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    got = arrow_map(fit.select("x"), run, "dim bigint, high bigint, low bigint, n bigint, most bigint").groupBy("dim").agg(exact("high"), exact("low"), F.sum("n").alias("n"), F.max("most").alias("most"))
    got = sorted(got.collect(), key=lambda r: r["dim"])
    return Mean(got[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in got], max(r["most"] for r in got))


def summed(fit: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``part(block of rows)``, a matrix of rows of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0, width):
            more = part(x)
            total = more if total is None else total + more
        if total is not None:
            task = TaskContext.get().partitionId()
            for low in range(0, len(total), ROWS):
                rows = total[low : low + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(rows))), pa.array([task] * len(rows), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["i", "task", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        done: Callable[[], pa.RecordBatch] = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["i", "row"])
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(2)):
                row = np.frombuffer(row.as_buffer(), np.float64)
                if i == at:
                    total = total + row
                else:
                    if at is not None:
                        yield done()
                    at, total = i, row
        if at is not None:
            yield done()

    parts = arrow_map(fit.select("x"), run, "i bigint, task int, row binary")
    rows = arrow_map(parts.repartition("i").sortWithinPartitions("i", "task"), add, "i bigint, row binary").collect()
    return np.array([np.frombuffer(r["row"], np.float64) for r in sorted(rows, key=lambda r: r["i"])]).reshape(-1, size)


@dataclass
class Whitening:
    """Mean, unit components (columns, by falling eigenvalue), eigenvalues and what the fit measured."""

    mean: Mean
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.mean.s)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centre(x) @ self.vectors / np.sqrt(self.values)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vec_id, x`` of the model's width."""
        k = len(self.values)
        model, share = self, [float(e / self.trace) for e in self.values]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in _blocks(batches, 1, model.width):
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.mean.n)), model.mean.deviation(x).take(each), pa.array(model.project(x).reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        return arrow_map(rows.select("vec_id", "x"), run, RESULT)


def fit(vectors: DataFrame, width: int, components: int = 4, oversampling: int = 8, passes: int = 4, seed: int = 11) -> Whitening | None:
    """The model of the distinct vectors ``x``; None if no direction has variance."""
    centre = mean(vectors, width)
    size = min(width, components + oversampling)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    for done in range(1, passes + 2):
        if full := size == width or done > passes:
            basis, size = np.eye(width), width

        def part(x: np.ndarray, basis: np.ndarray = basis) -> np.ndarray:
            x = centre.centre(x)
            # the last column: what each dimension adds to the trace
            return np.column_stack([x.T @ (x @ basis), (x * x).sum(0)]) / centre.n

        got = summed(vectors, width, part, size + 1)
        product, trace = got[:, :-1], float(got[:, -1].sum())
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        values, turn = values[order], turn[:, order]
        found = basis @ turn
        residual = np.linalg.norm(product @ turn - found * values, axis=0)
        if full or (residual <= 16 * np.finfo(float).eps * np.sqrt(width) * trace).all():
            keep = values > width * np.finfo(float).eps * max(values[0], 0)
            if not keep.any():
                return None
            model = Whitening(centre, found[:, keep] / np.linalg.norm(found[:, keep], axis=0), values[keep], trace, done, full and width > components + oversampling)
            model.identity_error = identity_error(vectors, model)
            return model
        basis = np.linalg.qr(product)[0]
    raise AssertionError("the full dimension ends the loop")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.vstack([w.T @ w, w.sum(0)])

    got = summed(vectors, model.width, part, k) / model.mean.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4, oversampling: int = 8, passes: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every sound row and component."""
    rows = whole_numbers(df, id_col, vector_col, scale)
    vectors = materialise(rows.select("x").distinct(), "whitening")
    sizes = vectors.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    width = sizes["high"] or 0
    if sizes["low"] != sizes["high"]:
        rows, vectors = filled(rows, width), materialise(filled(vectors, width).distinct(), "whitening")
    model = fit(vectors, width, components, oversampling, passes) if width else None
    if model is None:
        return df.sparkSession.createDataFrame([], RESULT)
    return model.transform(rows)
