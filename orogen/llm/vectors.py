"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets.

A hash turns a vector by rounds of random signs and fast Hadamard transforms and
takes its closest signed axis; ``k`` such axes name a bucket of one table. Each vector has a
home bucket in every table and visits the next likely ones (multiprobe). ``k`` grows with
the logarithm of the number of vectors, so that buckets keep their size; it can be given as well.

Equal vectors are one row first, with their count and a number of its own (``rid``). In a bucket, home rows are compared with
all rows by matrix products in double precision; every pair with cosine at or over the
threshold is a link, and pairs below it never are. A pair that meets in several buckets
counts in the first only, which both rows can tell from their bucket lists, so that link
counts are sums and no pair is ever emitted: a bucket returns counts and a spanning forest.
Every bucket over ``slice_rows`` rows is cut into slices that meet two by two. Buckets are counted and cut on
narrow rows (ids and bucket numbers, written once); vectors join them last.

The number of tables for each ``k`` is such that two vectors of cosine 0.95 share no bucket once in
some thousand times, in 64 to 256 dimensions; ``k`` above 5 is not offered (it would be due at 34 billion vectors:
from there buckets grow, and slices keep them in bounds).

Cases: vectors that are null, zero, empty or hold null or non-finite components link with
nothing; vectors of different lengths do not link; rows that repeat a ``vec_id`` with one
vector count as copies of each other, those with different vectors as different vectors; rows of null ``vec_id`` are returned and linked to nothing; an empty
table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.shared import arrow_map, components, discard, materialise
from orogen.llm.simhash import forest

TABLES = {1: 4, 2: 7, 3: 12, 4: 20, 5: 36}
PROBES = {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two columns), orthonormal."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


@lru_cache(64)
def signs(width: int, table: int, part: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width, table, part]).choice([-1.0, 1.0], size=(3, width))


def axes(unit: np.ndarray, table: int, part: int, seed: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` closest signed axes of each row after the rotation, and their lengths."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    for s in signs(width, table, part, seed):
        x = hadamard(x * s)
    order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :top]
    value = np.take_along_axis(x, order, 1)
    return 2 * order + (value < 0), np.abs(value)


def buckets(unit: np.ndarray, k: int, tables: int, probes: int, seed: int) -> np.ndarray:
    """Rows by tables by (home, probes): bucket numbers."""
    width = 2 << max(1, (unit.shape[1] - 1).bit_length())
    out = np.zeros((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        found = [axes(unit, t, i, seed, 1 + probes) for i in range(k)]
        home = sum(a[:, 0] * width**i for i, (a, _) in enumerate(found))
        moves = [(a[:, 0, None] * 0 + home[:, None] + (a[:, 1:] - a[:, :1]) * width**i, v[:, :1] - v[:, 1:]) for i, (a, v) in enumerate(found)]
        there, loss = np.concatenate([m for m, _ in moves], 1), np.concatenate([c for _, c in moves], 1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = home
        out[:, t, 1:] = np.take_along_axis(there, best, 1)
    return out


def code_type(length: int, k: int) -> str:
    """Narrowest integers that hold the bucket numbers of vectors of ``length``."""
    return "<i4" if (2 << max(1, (length - 1).bit_length())) ** k < 1 << 31 else "<i8"


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component goes first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def counted_here(own: np.ndarray, other: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether each pair's first common bucket is this one; ``own`` holds the rows of the smaller ids."""
    a = (other == own[:, :, :1]).any(axis=2)  # the home of the first is among the second's
    b = (own == other[:, :, :1]).any(axis=2)
    first = (a | b).argmax(axis=1)
    at = np.arange(len(own))
    home = np.where(a[at, first], own[at, first, 0], other[at, first, 0])
    return (first == table) & (home == bucket)


def compare(cells: DataFrame, k: int, tables: int, probes: int, threshold: float, kind: str, block: int = 512) -> DataFrame:
    """Counts and forest edges of each cell; ``cells`` is sorted by cell, ``kind`` the input's own precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def cell():
            rows = pa.Table.from_batches(held)
            t, b, s, u = key[1], key[2], key[3], key[4]
            home = rows["home"].to_numpy(zero_copy_only=False)
            rid, n, part = rows["rid"].to_numpy(), rows["n"].to_numpy(), rows["part"].to_numpy()
            codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), code_type(key[0], k)).reshape(len(rid), tables, 1 + probes)
            x = np.frombuffer(b"".join(rows["vec"].to_pylist()), kind).reshape(len(rid), -1).astype(np.float64)
            unit = unit_rows(x)
            add, a, e = np.zeros(len(rid), np.int64), [], []
            left = np.flatnonzero(part == s)
            right = np.flatnonzero(part == u)
            for low in range(0, len(left), block):
                i_at = left[low : low + block]
                for begin in range(0, len(right), block):
                    j_at = right[begin : begin + block]
                    i, j = np.nonzero(unit[i_at] @ unit[j_at].T >= threshold)
                    i, j = i_at[i], j_at[j]
                    ok = (home[i] | home[j]) & ((rid[i] < rid[j]) if s == u else (rid[i] != rid[j]))
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    swap = rid[i] > rid[j]
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    ok = counted_here(codes[i], codes[j], t, b)
                    i, j = i[ok], j[ok]
                    if len(i):
                        np.add.at(add, i, n[j])
                        np.add.at(add, j, n[i])
                        p, q = forest(rid[i], rid[j])
                        a.append(p)
                        e.append(q)
            hit = np.flatnonzero(add)
            if len(hit):
                edges = sum(map(len, a))
                out.append((np.concatenate([rid[hit], *a]), np.concatenate([add[hit], np.zeros(edges, np.int64)]), np.concatenate([rid[hit], *e])))

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)]
            change = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            edge = (np.flatnonzero(change) + 1).tolist()
            for low, high in zip([0, *edge], [*edge, batch.num_rows]):
                if low == high:
                    continue
                now = tuple(int(c[low]) for c in cols)
                if key is not None and now != key:
                    if sum(h.num_rows for h in held) > 1:
                        cell()
                    held.clear()
                key = now
                held.append(batch.slice(low, high - low))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rid", "add", "other"])
                out.clear()
        if key is not None and sum(h.num_rows for h in held) > 1:
            cell()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rid", "add", "other"])

    return arrow_map(cells, run, "rid bigint, add bigint, other bigint")


def coded(classes: DataFrame, k: int, seed: int, kind: str) -> DataFrame:
    """``width, rid, n, cells, codes, vec``: each vector's bucket numbers (also packed) and its components packed."""
    tables, probes = TABLES[k], PROBES[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                mine = whole.filter(pa.array(lengths == d))
                for low in range(0, mine.num_rows, 512):
                    batch = mine.slice(low, 512)
                    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    cells = buckets(unit_rows(x), k, tables, probes, seed).reshape(len(x), -1)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.reshape(-1)))
                    packed = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (cells.astype(code_type(d, k)), x.astype(kind))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d)), batch.column(0), batch.column(1), flat, *packed], names=["width", "rid", "n", "cells", "codes", "vec"])

    return materialise(arrow_map(classes.select("rid", "n", "vec"), run, "width bigint, rid bigint, n bigint, cells array<bigint>, codes binary, vec binary"), "vectors-codes")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, slice_rows: int = 4096, seed: int = 7, k: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    # single-precision input travels as it is: it widens to the same doubles where it is compared
    single = df.select(vector_col).dtypes[0][1] == "array<float>"
    kind, vec_type = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(vec_type).alias("vec"))
    sound = F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    classes = rows.where(F.coalesce(sound, F.lit(False))).groupBy("vec").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.withColumn("rid", F.monotonically_increasing_id()), "vectors-classes")
    if k is None:
        k = min(5, max(1, math.ceil(math.log(max(classes.count(), 2) / 128) / math.log(128))))
    tables, probes = TABLES[k], PROBES[k]
    codes = coded(classes, k, seed, kind)
    visits = 1 + probes
    cells = codes.select("width", "rid", F.posexplode("cells").alias("at", "b"))
    cells = cells.select("width", F.expr(f"at div {visits}").alias("t"), "b", "rid", (F.col("at") % visits == 0).alias("home"))
    place = ["width", "t", "b"]
    hot = cells.groupBy(place).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > slice_rows)
    hot = materialise(hot.select(*place, F.ceil(F.col("rows") / slice_rows).cast("bigint").alias("slices")), "vectors-hot")
    cells = cells.join(hot, place, "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("bigint")))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("slices")))
    cells = cells.withColumn("meets", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    cells = cells.select(*place, F.least("part", "meets").alias("s"), F.greatest("part", "meets").alias("u"), "home", "rid", "part")
    cells = cells.join(codes.select("rid", "n", "codes", "vec"), "rid").select(*place, "s", "u", "home", "rid", "n", "part", "codes", "vec")
    cells = cells.repartition(*place, "s", "u").sortWithinPartitions(*place, "s", "u")
    found = materialise(compare(cells, k, tables, probes, threshold, kind), "vectors-found")
    discard(codes, hot)
    counts = found.groupBy("rid").agg(F.sum("add").alias("more"))
    roots = components(found.where("rid <> other").select(F.col("rid").alias("a"), F.col("other").alias("b")), "vectors-components")
    named = roots.select(F.col("v").alias("rid"), "root").join(classes.select("rid", "low"), "rid")
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("rid", "component_id")
    label = classes.join(counts, "rid", "left").join(named, "rid", "left")
    label = materialise(label.select("vec", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")), "vectors-labels")
    alone = F.col("vec_id").isNull()
    out = rows.join(label, "vec", "left").select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
