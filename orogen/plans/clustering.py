"""Parameter-free hierarchical clustering of integer points: fit and transform.

The divisive phase works in waves: the marginals of all open blocks are made at once (map-side sums, one
exchange of occupied positions) and kept in files, the best cut of every block is found from them, and the driver
replays the best-first order with the results. Of two new blocks only the smaller one's points are read: the
other one's marginals are the parent's without these. Where half the points lie in closed blocks, the
others are written once by block, so that later waves leave the closed ones' files alone. Blocks are a column expression,
so there is no data set per block. Refinement takes two more jobs, labels are one narrow projection.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.functions import exact, geometry
from orogen.operators import refine, stats, valley
from orogen.operators.refine import Block, Summary
from orogen.sources.points import INT_MAX, INT_MIN, write_labels
from orogen.sources.scratch import Scratch

#: Blocks or clusters that a plan lists one by one; more are looked up in constant arrays, with the same results.
LISTED = 64


@dataclass
class Options:
    valley_share: float = 0.10
    split_ratio: float = 0.7
    merge_ratio: float = 0.9
    radius_multiplier: float = 3.0
    zero_radius: str = "exact"
    valley_mode: str = "first_dim"
    valley_plateaus: bool = False
    least_restricted: int = 10


def block_column(blocks: dict[int, Block], cols: Sequence[str]) -> Column:
    """The leaf of every point, one expression for the whole tree whatever its size and depth."""
    if sum(b.children is None for b in blocks.values()) <= LISTED:
        return listed_blocks(blocks, cols)
    return walked_blocks(blocks, cols)


def listed_blocks(blocks: dict[int, Block], cols: Sequence[str], at: int = 0) -> Column:
    """The leaf as nested conditions built from the tree."""
    b = blocks[at]
    if b.children is None:
        return F.lit(b.id)
    left, right = b.children
    return F.when(F.col(cols[b.dim]) <= b.pos, listed_blocks(blocks, cols, left)).otherwise(listed_blocks(blocks, cols, right))


@dataclass
class Walk:
    """Questions that lead to a leaf: is the point in a box (``low``, ``high``: positions by question and dimension)?

    ``yes`` and ``no`` are the next question's number, or -1 - block. ``depth`` questions at most.
    """

    low: np.ndarray
    high: np.ndarray
    yes: list[int]
    no: list[int]
    depth: int

    @classmethod
    def of(cls, blocks: dict[int, Block], at: int = 0) -> Walk:
        """Each question asks for the subtree that parts the leaves left over most evenly, so that their number
        grows with the logarithm of the leaves, however deep the tree is."""
        d = len(blocks[at].inf)
        # a box holds only what cuts ask for: points outside the root's box have a leaf as well
        bounds = {at: ((INT_MIN,) * d, (INT_MAX,) * d)}
        order = [at]
        for i in order:
            b = blocks[i]
            if b.children:
                (low, high), k = bounds[i], b.dim
                bounds[b.children[0]] = low, (*high[:k], b.pos, *high[k + 1 :])
                bounds[b.children[1]] = (*low[:k], b.pos + 1, *low[k + 1 :]), high
                order += b.children
        asked, yes, no, depth, cut = [], [], [], 0, set()
        todo = [(at, None, 0)]  # a subtree without those cut off it, and the answer that leads there
        while todo:
            top, answer, deep = todo.pop()
            part, sizes = [top], {}
            for i in part:
                part += [c for c in blocks[i].children or () if c not in cut]
            for i in reversed(part):
                kids = [c for c in blocks[i].children or () if c not in cut]
                sizes[i] = sum(sizes[c] for c in kids) if blocks[i].children else 1
            if sizes[top] == 1:
                target = -1 - next(i for i in part if blocks[i].children is None)
            else:
                target, half = len(asked), sizes[top] / 2
                best = min((i for i in part if 0 < sizes[i] < sizes[top]), key=lambda i: (abs(sizes[i] - half), i))
                asked.append(best)
                yes.append(0)
                no.append(0)
                depth = max(depth, deep + 1)
                todo += [(best, (yes, target), deep + 1), (top, (no, target), deep + 1)]
                cut.add(best)
            if answer:
                answer[0][answer[1]] = target
        low, high = (np.array([bounds[i][k] for i in asked], np.int64).reshape(-1, d) for k in (0, 1))
        return cls(low, high, yes, no, depth)


def walked_blocks(blocks: dict[int, Block], cols: Sequence[str]) -> Column:
    """The leaf by ``Walk``: a few look-ups in constant arrays for each point."""
    walk = Walk.of(blocks)
    if not walk.yes:
        return F.lit(0)
    boxes = [(geometry.constants(walk.low[:, i].tolist(), "int"), geometry.constants(walk.high[:, i].tolist(), "int")) for i in range(len(cols))]
    yes, no = geometry.constants(walk.yes, "int"), geometry.constants(walk.no, "int")

    def ask(at: Column, _: Column) -> Column:
        inside = reduce(lambda a, b: a & b, [F.col(c).between(F.element_at(low, at + 1), F.element_at(high, at + 1)) for c, (low, high) in zip(cols, boxes)])
        return F.when(at < 0, at).when(inside, F.element_at(yes, at + 1)).otherwise(F.element_at(no, at + 1))

    return -1 - F.aggregate(F.sequence(F.lit(1), F.lit(walk.depth)), F.lit(0), ask)


@dataclass
class Model:
    """Fitted clusters; ``transform`` labels any batch or streaming DataFrame."""

    cols: list[str]
    blocks: dict[int, Block]
    trace: list[dict]
    refined: list[Summary]
    clusters: list[Summary]
    merges: list[dict]
    options: Options
    metrics: dict = field(default_factory=dict)

    @property
    def leaves(self) -> list[Block]:
        return [b for b in self.blocks.values() if b.children is None]

    @property
    def number_of_clusters(self) -> int:
        """After merging."""
        return len(self.clusters)

    @property
    def number_of_blocks(self) -> int:
        """Blocks that are no outliers, before merging."""
        return sum(not b.is_outlier for b in self.leaves)

    def transform(self, df: DataFrame, label: str = "label") -> DataFrame:
        """``df`` with the nearest ellipse's number, or -1 for outliers."""
        m, zero = self.options.radius_multiplier, self.options.zero_radius
        centers, rhos = [c.centroid for c in self.clusters], [[m * r for r in c.radii] for c in self.clusters]
        if len(centers) > LISTED:
            grid = geometry.Grid.of(*refine.ellipse_boxes(np.array(centers), np.array(rhos), zero))
            return geometry.with_candidates(df, label, self.cols, *grid.candidates(self.cols), centers, rhos, zero, -1)
        found = [(i, geometry.elliptical(self.cols, c, r, zero)) for i, (c, r) in enumerate(zip(centers, rhos))]
        return geometry.with_nearest(df, label, found, -1)

    def block_labels(self, df: DataFrame, label: str = "block") -> DataFrame:
        return df.withColumn(label, block_column(self.blocks, self.cols))


class Marginals:
    """Marginals of blocks in files of the shared folder: a table for each wave, deleted when none of its blocks is open."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.tables, self.table_of = scratch, [], {}

    def add(self, df: DataFrame, ids: Iterable[int]) -> DataFrame:
        table = self.scratch.write(df, "marginals")
        self.tables.append((table, set(ids)))
        self.table_of |= {i: len(self.tables) - 1 for i in ids}
        return table

    def of(self, ids: Iterable[int]) -> DataFrame:
        places: dict[int, list[int]] = {}
        for i in ids:
            places.setdefault(self.table_of[i], []).append(i)
        return reduce(DataFrame.union, [self.tables[t][0].where(F.col("block").isin(part)) for t, part in sorted(places.items())])

    def done(self, ids: Iterable[int]) -> None:
        for i in ids:
            if i in self.table_of:
                table, open_ = self.tables[self.table_of.pop(i)]
                open_.discard(i)
                if not open_:
                    self.scratch.delete(table)


class Stored:
    """Points as waves read them: from half the points in closed blocks on, the others in files by block, written again whenever half of these are closed."""

    def __init__(self, points: DataFrame, cols: Sequence[str], n: int, scratch: Scratch):
        self.points, self.cols, self.n, self.scratch = points, list(cols), n, scratch
        self.tag: set[int] = set()

    def tags(self, blocks: dict[int, Block], wanted: Iterable[int]) -> set[int]:
        """The written blocks in which the wanted ones lie."""
        out = set()
        for i in wanted:
            while i not in self.tag:
                i = blocks[i].parent
            out.add(i)
        return out

    def shrink(self, blocks: dict[int, Block], open_: Iterable[int]) -> None:
        """Write the points of the open leaves anew if they are half of all at most."""
        left = sum(blocks[i].summary.n for i in open_)
        if 2 * left <= self.n:
            old, written = self.points, bool(self.tag)
            rows = self.read(blocks, open_).withColumn("_tag", block_column(blocks, self.cols)).where(F.col("_tag").isin(list(open_)))
            self.points, self.n, self.tag = self.scratch.write(rows.hint("rebalance", "_tag"), "points", "_tag"), left, set(open_)
            if written:
                self.scratch.delete(old)

    def read(self, blocks: dict[int, Block], wanted: Iterable[int]) -> DataFrame:
        """The points of the wanted leaves, and of others as far as they lie in the same files."""
        if not self.tag:
            return self.points
        return self.points.where(F.col("_tag").isin(sorted(self.tags(blocks, wanted)))).select(*self.cols)


class Clusterer:
    """``fit`` finds the number of clusters and their ellipses."""

    def __init__(self, cols: Sequence[str], options: Options | None = None):
        self.cols, self.options, self.wide = list(cols), options or Options(), True
        #: points read for marginals by wave; occupied positions in which cuts were sought, of all
        self.scanned, self.read, self.positions = [], 0, 0

    def fit(self, df: DataFrame) -> Model:
        points = df.select(*[F.col(c).cast("int").alias(c) for c in self.cols])
        held = points.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(held)
        finally:
            held.unpersist()

    def _fit(self, points: DataFrame) -> Model:
        clock, metrics = time.monotonic(), {}

        def lap(name: str) -> None:
            nonlocal clock
            metrics[name] = round((time.monotonic() - clock) * 1000)
            clock = time.monotonic()

        root = self.root(points)
        lap("init_ms")
        blocks, trace, jobs = self.divide(points, root)
        lap("divisive_ms")
        leaves = [b for b in blocks.values() if b.children is None]
        self.find_outliers(points.withColumn("block", block_column(blocks, self.cols)), leaves)
        refined = self.reassign(points, blocks, leaves)
        lap("intermediate_ms")
        clusters, merges = refine.merge(refined, self.options.merge_ratio)
        clusters.sort(key=lambda s: s.centroid)
        lap("agglomerative_ms")
        metrics |= {"split_jobs": jobs, "blocks": len(leaves), "after_intermediate": len(refined), "clusters": len(clusters)}
        metrics |= {"points_scanned": sum(self.scanned), "positions_read": self.read, "positions": self.positions}
        return Model(self.cols, blocks, trace, refined, clusters, merges, self.options, metrics)

    def root(self, points: DataFrame) -> Block:
        d = len(self.cols)
        bounds = [f(c).alias(f"{k}{i}") for i, c in enumerate(self.cols) for f, k in ((F.min, "inf"), (F.max, "sup"))]
        nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null{i}") for i, c in enumerate(self.cols)]
        r = points.agg(*stats.sums(self.cols, None), *bounds, *nulls).first()
        if any(r[f"{k}{i}"] is None for i in range(d) for k in ("ls", "ss")):  # more than bigint holds, or no points
            r = points.agg(*stats.sums(self.cols), *bounds, *nulls).first()
        if not r["n"]:
            raise ValueError("there are no points")
        if any(r[f"null{i}"] for i in range(d)):
            raise ValueError("points have null coordinates")
        got = lambda k: tuple(int(r[f"{k}{i}"]) for i in range(d))
        # sums of bigint hold as long as no block's sum of squares can pass 2 ** 63
        self.wide = r["n"] * max(abs(x) for x in (*got("inf"), *got("sup"))) ** 2 >= 1 << 62
        return Block(0, Summary(r["n"], got("ls"), got("ss")), got("inf"), got("sup"))

    def marginals(self, points: DataFrame, blocks: dict[int, Block], wanted: Sequence[int]) -> DataFrame:
        """Marginals of leaves, from their points."""
        rows = points.withColumn("_block", block_column(blocks, self.cols)).where(F.col("_block").isin(list(wanted)))
        return stats.marginals(rows, self.cols, "_block", self.wide)

    def wave(self, stored: Stored, blocks: dict[int, Block], open_: Sequence[int], state: Marginals) -> None:
        """Best cuts of the open leaves that have none yet. Points are read of the smaller one of two sisters only, if the parent's marginals are there."""
        d, root, wanted = len(self.cols), blocks[0], [i for i in open_ if blocks[i].best is None]
        parents = {blocks[i].parent for i in wanted} & state.table_of.keys()
        pairs = {p: sorted(blocks[p].children, key=lambda i: (blocks[i].summary.n, i)) for p in parents}
        scan = [i for i in wanted if blocks[i].parent not in pairs] + [small for small, _ in pairs.values()]
        self.scanned.append(sum(blocks[i].summary.n for i in scan))
        stored.shrink(blocks, {*open_, *scan})
        made, larger = self.marginals(stored.read(blocks, scan), blocks, scan), [(p, small, large) for p, (small, large) in pairs.items() if large in wanted]
        if larger:
            names = made.sparkSession.createDataFrame(larger, "parent int, small int, large int")
            made = stats.with_sisters(made, state.of(p for p, _, _ in larger), names)
        state.add(made, [*scan, *(large for _, _, large in larger)])
        found = stats.bounded_splits(state.of(wanted), d, root.inf, stats.part_shifts(root.inf, root.sup))
        best = {r["block"]: r.asDict() for r in found.collect()}
        for i in wanted:
            blocks[i].best = best.get(i, {})
        self.read += sum(b["read"] for b in best.values())
        self.positions += sum(b["all_positions"] for b in best.values())
        state.done([*parents, *(set(scan) - set(wanted))])

    def valleys(self, counts: DataFrame, blocks: dict[int, Block], wanted: Sequence[int]) -> None:
        """Results of the valley test for the wanted leaves in every dimension, in one job that returns only these; ``counts`` are their marginals."""
        o = self.options
        boxes = valley.box_frame(counts.sparkSession, [(i, d, lo, hi - lo + 1, blocks[i].summary.n, i == 0) for i in wanted for d, (lo, hi) in enumerate(zip(blocks[i].inf, blocks[i].sup))])
        for i in wanted:
            blocks[i].marks = [(False, False)] * len(self.cols)
        with Scratch(counts.sparkSession) as scratch:
            for r in valley.verdicts(counts.select("block", "dim", "pos", F.col("cnt").alias("n")), boxes, o.valley_share, o.valley_plateaus, scratch.write).collect():
                blocks[r["block"]].marks[r["dim"]] = (r["found"], r["further"])

    def valley(self, blocks: dict[int, Block], at: int) -> bool:
        return valley.has_valley(blocks[at].marks, self.options.valley_mode)

    def divide(self, points: DataFrame, root: Block) -> tuple[dict[int, Block], list[dict], int]:
        with Scratch(points.sparkSession) as scratch:
            return self._divide(points, root, scratch)

    def _divide(self, points: DataFrame, root: Block, scratch: Scratch) -> tuple[dict[int, Block], list[dict], int]:
        state, stored = Marginals(scratch), Stored(points, self.cols, root.summary.n, scratch)
        blocks, ids, trace, jobs = {0: root}, count(1), [], 0
        n, k, best = root.summary.n, 1, 0.0
        within, between = root.summary.ssq, 0.0
        queue = [(-root.summary.ssq, 0)] if root.summary.ssq > 0 else []
        while queue:
            _, at = heapq.heappop(queue)
            b = blocks[at]
            if b.best is None:
                self.wave(stored, blocks, [at, *(x for _, x in queue)], state)
                jobs += 1
            cut = b.best
            if not cut or not cut["delta"] > 0:
                state.done([at])
                continue
            index = exact.calinski_harabasz(between + cut["delta"], within - cut["delta"], n, k + 1)
            accept, by = k > 1 and index >= best, "index"
            if not accept and index >= self.options.split_ratio * best:
                if b.marks is None:
                    wanted = [i for i in [at, *(x for _, x in queue)] if blocks[i].marks is None and i in state.table_of]
                    self.valleys(state.of(wanted), blocks, wanted)
                    jobs += 1
                accept, by = self.valley(blocks, at), "valley"
            trace.append({"block": at, "dim": cut["dim"], "pos": cut["pos"], "n1": cut["n1"], "delta": cut["delta"], "index": index, "accepted": accept, "by": by if accept else "none"})
            if not accept:
                state.done([at])
                continue
            k, best, within, between = k + 1, max(best, index), within - cut["delta"], between + cut["delta"]
            d = len(self.cols)
            left = Summary(cut["n1"], tuple(int(cut[f"l{i}"]) for i in range(d)), tuple(int(cut[f"r{i}"]) for i in range(d)))
            right = b.summary.minus(left)
            i, j = next(ids), next(ids)
            dim, pos = cut["dim"], cut["pos"]
            swap = lambda box, v: tuple(v if x == dim else y for x, y in enumerate(box))
            blocks[i] = Block(i, left, b.inf, swap(b.sup, pos), at)
            blocks[j] = Block(j, right, swap(b.inf, pos + 1), b.sup, at)
            b.dim, b.pos, b.children = dim, pos, (i, j)
            for x in (i, j):
                if blocks[x].summary.ssq > 0:
                    heapq.heappush(queue, (-blocks[x].summary.ssq, x))
        return blocks, trace, jobs

    def find_outliers(self, points: DataFrame, leaves: list[Block]) -> None:
        """Marks the sparse leaves that aren't dense in the middle either; ``points`` name their leaf in ``block``."""
        ranked = sorted(leaves, key=lambda b: b.log_density)
        limit = ranked[refine.jump_index([b.density for b in ranked])].density
        candidates = [b for b in leaves if b.density <= limit]
        boxes = {b.id: refine.restricted_box(b) for b in candidates}
        # middles by block in constant arrays; the others' are empty
        size, at, held = max(b.id for b in leaves) + 1, F.col("block") + 1, points
        for k, c in enumerate(self.cols):
            low, high = ([boxes[i][x][k] if i in boxes else 1 - x for i in range(size)] for x in (0, 1))
            held = held.where(F.col(c).between(F.element_at(geometry.constants(low, "int"), at), F.element_at(geometry.constants(high, "int"), at)))
        counts = {r["block"]: r["n"] for r in held.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in candidates:
            n, box = counts.get(b.id, 0), boxes[b.id]
            b.is_outlier = n < self.options.least_restricted or n / exact.volume(*box) < 2 * b.density

    def assign(self, points: DataFrame, blocks: dict[int, Block], leaves: list[Block], label: str = "_cluster") -> DataFrame:
        """``points`` with the nearest reachable cluster (its block's id), or null."""
        o, models = self.options, [b for b in leaves if not b.is_outlier]
        reach = refine.reachability(leaves, o.radius_multiplier, o.zero_radius)
        centers, rhos = [b.summary.centroid for b in models], [[o.radius_multiplier * r for r in b.summary.radii] for b in models]
        rows = points.withColumn("_block", block_column(blocks, self.cols))
        if len(leaves) > LISTED and models:
            number = {b.id: k for k, b in enumerate(models)}
            lists = [sorted(number[i] for i in reach.get(at, ())) for at in range(max(blocks) + 1)]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).tolist()
            lists = geometry.constants(starts, "int"), geometry.constants([k for x in lists for k in x], "int")
            rows = geometry.with_candidates(rows, "_nearest", self.cols, F.col("_block") + 1, *lists, centers, rhos, o.zero_radius)
            return rows.withColumn(label, F.element_at(geometry.constants([b.id for b in models], "int"), F.col("_nearest") + 1)).drop("_block", "_nearest")
        found = [(b.id, F.when(F.col("_block").isin([i for i, s in reach.items() if b.id in s]), geometry.elliptical(self.cols, c, r, o.zero_radius))) for b, c, r in zip(models, centers, rhos)]
        return geometry.with_nearest(rows, label, found).drop("_block")

    def reassign(self, points: DataFrame, blocks: dict[int, Block], leaves: list[Block]) -> list[Summary]:
        d = len(self.cols)
        # points of no cluster are a group of their own here: a filter would have the distances computed twice
        rows = stats.summaries(self.assign(points, blocks, leaves), self.cols, ["_cluster"], self.wide).collect()
        got = [Summary(r["n"], tuple(int(r[f"ls{i}"]) for i in range(d)), tuple(int(r[f"ss{i}"]) for i in range(d))) for r in rows if r["_cluster"] is not None]
        got.sort(key=lambda s: s.centroid)
        for i, s in enumerate(got):
            s.id = i
        return got


def fit(df: DataFrame, cols: Sequence[str], labels: str | None = None, report: bool = False, **options) -> Model:
    """The fitted model; with ``labels``, label lines of ``df`` are written there, with ``report`` the metrics are printed."""
    model = Clusterer(cols, Options(**options)).fit(df)
    if labels:
        write_labels(model.transform(df.select(*cols)), cols, labels)
    if report:
        for k, v in model.metrics.items():
            print(f"{k}: {v}")
    return model


def fit_predict(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    return fit(df, cols, **options).transform(df)
