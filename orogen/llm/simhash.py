"""SimHash near-deduplication by anchor-point covering.

Anchors are the words of the binary Golay code of length 23, which is perfect: every
23-bit point is within 3 bits of exactly one of its 4,096 words. A fingerprint of 64 bits
is read as three blocks of 23, 23 and 18 bits. Two fingerprints that differ in at most 4
bits differ in at most ``4 // 3 = 1`` bit of some block; there the second lies within
covering radius plus 1, that is 4, of the anchor the first is at home at. So each
fingerprint is a home row at one anchor of each block and a guest row at every anchor
within 4 (five others at most), and at each anchor home rows are compared with all rows on the
full 64 bits. No pair within the threshold can be missed.

Those 3 * 4,096 anchors are the same for any input, so their rows grow with it. From ``PAIR_FROM`` distinct
fingerprints on anchors are taken over two blocks at once: 3 * 4,096 * 4,096. Of at most 4 differing bits, some two blocks, in
the order 1-2, 2-3 or 3-1, hold one of the splits in ``SPLITS``; a split of (i, j) bits needs guests within 3 + i of the
first block's word and 3 + j of the second's. Both ways find every pair; the second replicates a
fingerprint to some 134 anchors and not 16, the first compares each with ever more others.

Equal fingerprints are one row before anything is replicated. Home rows of the anchors are counted,
and where an anchor has more than ``slice_rows`` its home rows are split into slices that meet all guests (the
count table of single blocks is broadcast, bounded by the number of anchors; that of two blocks never by a hint). A slice
streams its guests in blocks and emits a spanning forest of the links it finds, never all pairs. Components come from
``shared.components``.

Cases: null text counts as empty; a text without words has fingerprint zero and links like
any other; fewer words than a shingle: the whole sequence is one shingle; repeated rows have
repeated results; rows of null ``doc_id`` are fingerprinted and get the component of their fingerprint's class (null when the whole component has no id);
an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.bpe import small_batches
from orogen.llm.shared import arrow_map, components, materialise

BLOCKS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b101011100011  # fixed value: generator polynomial of the Golay code
GOLAY_BITS = 23

#: Distinct fingerprints from which anchors over two blocks cost less than those over one.
PAIR_FROM = 1 << 24
#: Differing bits in the first and second block of a pair that its guests allow for.
SPLITS = ((0, 0), (0, 1), (1, 0), (1, 1), (2, 0))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, seed)
    start = [0, *accumulate(len(p) + 1 for p in parts)]
    hashes = np.fromiter((xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(start, start[words:])), np.uint64, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[low : low + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            got = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id bigint, fp bigint")


def syndrome(points: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit point by the generator polynomial: 11 bits."""
    rest = points.astype(np.int64)
    for bit in range(GOLAY_BITS - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def coset_table() -> tuple[np.ndarray, np.ndarray]:
    """For each of 2,048 syndromes its error patterns of weight 5 at most, lightest first, and how far each goes beyond weight 3.

    Rows are filled up with patterns that go too far for any use. Exactly one pattern is within weight 3.
    """
    patterns = [sum(1 << b for b in c) for w in range(6) for c in combinations(range(GOLAY_BITS), w)]
    rows: list[list[int]] = [[] for _ in range(2048)]
    for p, s in zip(patterns, syndrome(np.array(patterns)).tolist()):
        rows[s].append(p)
    width = max(map(len, rows))
    errors = np.array([r + [-1] * (width - len(r)) for r in rows], np.int64)
    return errors, np.where(errors < 0, 99, np.maximum(np.bitwise_count(errors).astype(np.int64) - 3, 0))


def words_within(fps: np.ndarray, block: int, beyond: int) -> np.ndarray:
    """Code words that lie ``beyond`` bits (0: none) outside the covering radius of a block of ``fps``, a row each, -1 filled."""
    low, bits = BLOCKS[block]
    points = (fps >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
    errors, over = coset_table()
    at = syndrome(points)
    use = np.flatnonzero((over == beyond).any(axis=0))
    return np.where(over[at][:, use] == beyond, points[:, None] ^ errors[at][:, use], -1)


def anchor_rows(fps: np.ndarray, paired: bool = False, home_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, fingerprint and home flag of every row that ``fps`` (uint64) is replicated to."""
    near = [[words_within(fps, b, beyond) for beyond in range(1 if home_only else 3 if paired else 2)] for b in range(len(BLOCKS))]
    out = []
    for number in range(len(BLOCKS)):
        second = near[(number + 1) % len(BLOCKS)]
        for i, j in SPLITS if paired else ((0, 0), (1, 0)):
            if home_only and i + j:
                continue
            anchor = near[number][i]
            if paired:
                both = (anchor[:, :, None] << GOLAY_BITS | second[j][:, None, :]).reshape(len(fps), -1)
                anchor = np.where(((anchor[:, :, None] < 0) | (second[j][:, None, :] < 0)).reshape(both.shape), -1, both)
            at, column = np.nonzero(anchor >= 0)
            out.append((number << 2 * GOLAY_BITS | anchor[at, column], fps[at], np.full(len(at), i + j == 0)))
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the least vertex for each component of the links ``a[i] - b[i]``."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    move = label != np.arange(len(ids))
    return ids[move], ids[label[move]]


def compare_at_anchors(rows: DataFrame, threshold: int, block: int = 2048) -> DataFrame:
    """Links ``a, b`` (fingerprints) found at anchors; ``rows``: anchor, slice, home, fp, sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, guests, found = None, [], [], []

        def meet():
            mine = np.concatenate(homes) if homes else np.zeros(0, np.uint64)
            others = np.concatenate(guests) if len(mine) else mine
            for low in range(0, len(mine), block):
                x = mine[low : low + block]
                for at in range(0, len(others), block):
                    y = others[at : at + block]
                    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= threshold)
                    keep = x[i] != y[j]
                    if keep.any():
                        a, b = forest(x[i[keep]], y[j[keep]])
                        found.append((a.view(np.int64), b.view(np.int64)))
            guests.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            home, fp = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64)
            edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(anchor)]))
            use = home[start]  # a place that begins with a guest has no home rows
            use[0] = True  # but the first may go on from the batch before
            for low, high in zip(start[use].tolist(), end[use].tolist()):
                if (anchor[low], part[low]) != key:
                    meet()
                    homes.clear()
                    key = (anchor[low], part[low])
                own = home[low:high]
                homes.append(fp[low:high][own])  # home rows come first and meet each other as well
                guests.append(fp[low:high])
                if not own.any() and sum(map(len, guests)) > 1 << 18:
                    meet()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])
                found.clear()
        meet()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])

    return arrow_map(rows, run, "a bigint, b bigint")


def links(fps: DataFrame, threshold: int = 4, slice_rows: int = 8192, paired: bool = False) -> DataFrame:
    """Links between the distinct fingerprints ``fp`` that differ in at most ``threshold`` bits: 0 to 5, or 4 if ``paired``."""
    if not 0 <= threshold <= (4 if paired else 5):
        raise ValueError("threshold: 0 to 5, so that one of three blocks differs in at most one bit; 0 to 4 for pairs of blocks")

    def spread(home_only: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, 2048):
                    anchor, fp, home = anchor_rows(whole.column(0).slice(low, 2048).to_numpy().view(np.uint64), paired, home_only)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(fp.view(np.int64))], names=["anchor", "home", "fp"])

        return arrow_map(fps.select("fp"), run, "anchor bigint, home boolean, fp bigint")

    sizes = spread(home_only=True).groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    rows = spread(home_only=False)
    if paired:
        hot = materialise(sizes.where("slices > 1"), "simhash-hot")
        rows = rows.join(hot, "anchor", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    else:
        rows = rows.join(F.broadcast(sizes), "anchor")
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    part = F.when(F.col("slices") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))
    rows = rows.select("anchor", F.explode(part).alias("part"), "home", "fp", own.alias("own"))
    rows = rows.select("anchor", "part", (F.col("home") & (F.col("part") == F.col("own"))).alias("home"), "fp")
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
    return compare_at_anchors(rows, threshold)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, threshold: int = 4, paired: bool | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; ``component_id`` is the smallest reachable ``doc_id``.

    ``paired`` takes anchors over two blocks; None decides by the number of distinct fingerprints. The links are the same.
    """
    prints = materialise(fingerprints(df, id_col, text_col, words, seed), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    if paired is None:
        paired = threshold <= 4 and classes.count() >= PAIR_FROM
    roots = components(links(classes, threshold, paired=paired), "simhash-components")
    joined = classes.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    label = materialise(joined.join(lowest, "root").select("fp", "component_id"), "simhash-labels")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")
