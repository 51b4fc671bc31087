"""The operators at sizes where nothing may be held or listed whole, against the plain forms."""

import heapq
import math
import random
import time
from itertools import combinations, count

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions import exact, geometry
from orogen.operators import refine, stats, valley
from orogen.operators.refine import Block, Summary
from orogen.plans import clustering
from orogen.plans.clustering import Clusterer, Walk, fit
from orogen.sources.scratch import Scratch


def frame(spark, rows, dims=None):
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"x{i} int" for i in range(dims or len(rows[0]))))


def summary(rows, id=0):
    a = np.array(rows, dtype=object).reshape(len(rows), -1)
    return Summary(len(a), tuple(int(x) for x in a.sum(0)), tuple(int(x) for x in (a * a).sum(0)), id)


# --- running sums and best cuts ------------------------------------------------------------


def points(seed, n, d=2):
    """Clumps and strewn points at very different widths, negative ones too."""
    r = np.random.default_rng(seed)
    scale = [10 ** int(r.integers(1, 9)) for _ in range(d)]
    centres = r.normal(0, 1, (int(r.integers(1, 5)), d))
    x = centres[r.integers(0, len(centres), n)] + r.normal(0, r.choice([0.01, 0.3]), (n, d))
    return np.rint(np.clip(x * scale, -(2**31), 2**31 - 1)).astype(np.int64).tolist()


def whole_sums(marginal):
    """Running sums by definition."""
    out, rows = [], sorted(marginal.collect(), key=lambda r: (r["block"], r["dim"], r["pos"]))
    names = [c for c in marginal.columns if c not in ("block", "dim", "pos")]
    totals, now = {}, {}
    for r in rows:
        for c in names:
            key = r["block"], r["dim"], c
            totals[key] = totals.get(key, 0) + r[c]
    for r in rows:
        for c in names:
            key = r["block"], r["dim"], c
            now[key] = now.get(key, 0) + r[c]
        out.append((r["block"], r["dim"], r["pos"], *[now[r["block"], r["dim"], c] for c in names], *[totals[r["block"], r["dim"], c] for c in names]))
    return out


@pytest.mark.parametrize("shifts", [None, [0, 3], [4, 30]])
def test_running_sums_in_two_levels(spark, shifts):
    rows = frame(spark, points(1, 400)).withColumn("b", F.col("x0") % 2)
    m = stats.marginals(rows, ["x0", "x1"], "b")
    got = stats.cumulative(m, 2, shifts)
    names = ["n1", "l0", "l1", "r0", "r1", "n", "t0", "t1", "u0", "u1"]
    want = {r[:3]: r[3:] for r in whole_sums(m)}
    assert {(r["block"], r["dim"], r["pos"]): tuple(r[c] for c in names) for r in got.collect()} == want


def test_no_window_holds_a_whole_dimension(spark):
    """A histogram of many positions is dealt over all tasks: windows over positions are parted by their range as well."""
    rows = spark.range(3_000_000).selectExpr("cast(id as int) as x0")
    m = stats.marginals(rows, ["x0"])
    got = stats.cumulative(m, 1, stats.part_shifts([0], [2_999_999]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "pos#" in line.split("windowspec")[0] + line.rsplit("[", 1)[-1]]
    assert windows and all("part#" in line for line in windows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as small partitions would be joined here
    try:
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 2 * 3_000_000 / 4
    assert len(stats.part_shifts([0], [10**8])) == 1 and (10**8 >> stats.part_shifts([0], [10**8])[0]) < 4096


@pytest.mark.parametrize("wide", [False, True])
def test_bounded_search_finds_the_cut_of_the_whole_search(spark, wide):
    read = positions = 0
    for seed in range(4):
        data = points(seed, 500, 1 + seed % 3)
        if not wide:
            data = [[x // 1000 for x in p] for p in data]
        d, cols = len(data[0]), [f"x{i}" for i in range(len(data[0]))]
        df = frame(spark, data)
        m = stats.marginals(df.withColumn("b", F.col("x0") % 3), cols, "b", wide)
        low, high = ([int(f(p[i] for p in data)) for i in range(d)] for f in (min, max))
        want = {r["block"]: r for r in stats.best_splits(stats.split_candidates(stats.cumulative(m, d), d), d).collect()}
        got = {r["block"]: r for r in stats.bounded_splits(m, d, low, stats.part_shifts(low, high)).collect()}
        assert got.keys() == want.keys()
        for b, r in got.items():
            assert all(float(r[c]) == float(want[b][c]) for c in want[b].asDict()), (seed, b)
            assert r["read"] <= r["all_positions"]
            read, positions = read + r["read"], positions + r["all_positions"]
    assert read < 0.7 * positions


def test_ties_of_cuts_survive_the_bounds(spark):
    rows = [(x, y) for x in (0, 1, 100, 101) for y in (0, 1, 100, 101)] * 3
    m = stats.marginals(frame(spark, rows), ["x0", "x1"])
    got = stats.bounded_splits(m, 2, [0, 0], [0, 0]).first()
    assert (got["dim"], got["pos"]) == (1, 1)
    one = stats.marginals(frame(spark, [(5, 5)] * 4), ["x0", "x1"])
    assert stats.bounded_splits(one, 2, [5, 5], [4, 4]).collect() == []


# --- marginals kept from wave to wave ------------------------------------------------------


def blobs(seed=3, n=400):
    r = np.random.default_rng(seed)
    parts = [r.normal(c, 11, (int(n * k), 2)) for c, k in (((0, 0), 1), ((90, 10), 0.5), ((400, 300), 0.8), ((800, 20), 2))]
    return np.rint(np.concatenate(parts)).astype(int).tolist()


class Rescanning(Clusterer):
    """Reads every new block's points, as if the parents' marginals were not kept."""

    def wave(self, stored, blocks, open_, state):
        for p in {blocks[i].parent for i in open_} & state.table_of.keys():
            state.table_of.pop(p)
        super().wave(stored, blocks, open_, state)


def test_sisters_by_retraction_give_the_same_trace(spark):
    rows = blobs()
    df = frame(spark, rows)
    work, plain = Clusterer(["x0", "x1"]), Rescanning(["x0", "x1"])
    model, other = work.fit(df), plain.fit(df)
    assert model.trace == other.trace and len(model.leaves) > 3
    assert [(b.id, b.summary, b.inf, b.sup) for b in model.leaves] == [(b.id, b.summary, b.inf, b.sup) for b in other.leaves]
    assert work.scanned[0] == plain.scanned[0] == len(rows)
    assert all(2 * a <= b for a, b in zip(work.scanned[1:], plain.scanned[1:], strict=True))
    assert model.metrics["points_scanned"] == sum(work.scanned) and 0 < model.metrics["positions_read"] <= model.metrics["positions"]


def test_closed_blocks_files_are_not_read(spark):
    df = frame(spark, [(x, y) for x in range(64) for y in range(64)])
    quarter = lambda a, b, i, p, **k: Block(i, summary([(x, y) for x in range(a[0], b[0] + 1) for y in range(a[1], b[1] + 1)]), a, b, p, **k)
    blocks = {
        0: quarter((0, 0), (63, 63), 0, None, dim=0, pos=31, children=(1, 2)),
        1: quarter((0, 0), (31, 63), 1, 0, dim=1, pos=31, children=(3, 4)),
        2: quarter((32, 0), (63, 63), 2, 0),
        3: quarter((0, 0), (31, 31), 3, 1),
        4: quarter((0, 32), (31, 63), 4, 1),
    }
    with Scratch(spark) as scratch:
        stored = clustering.Stored(df, ["x0", "x1"], 4096, scratch)
        stored.shrink(blocks, [2, 3, 4])
        assert stored.points is df  # nothing is closed
        stored.shrink(blocks, [3, 4])
        assert stored.n == 2048 and stored.points is not df
        seen = stored.read(blocks, [4]).select("*", F.input_file_name().alias("f"))
        assert seen.count() == 1024 and {r["f"].split("_tag=")[1][:1] for r in seen.select("f").distinct().collect()} == {"4"}
        folders = stored.points.select(F.input_file_name().alias("f")).distinct().collect()
        assert {r["f"].split("_tag=")[1][:1] for r in folders} == {"3", "4"}
        # a later cut of a written block: its new leaves lie in its files
        blocks[4].dim, blocks[4].pos, blocks[4].children = 0, 15, (5, 6)
        blocks[5], blocks[6] = quarter((0, 32), (15, 63), 5, 4), quarter((16, 32), (31, 63), 6, 4)
        assert stored.read(blocks, [5]).count() == 1024
        stored.shrink(blocks, [5])
        assert stored.n == 512 and stored.read(blocks, [5]).count() == 512


def test_scratch_goes_and_a_cluster_needs_a_shared_folder(spark):
    with Scratch(spark) as scratch:
        table = scratch.write(spark.range(5).toDF("v"), "t")
        assert table.count() == 5 and len(table.inputFiles()) > 0
    with pytest.raises(Exception):
        spark.read.parquet(table.written_to).count()

    class Far:
        conf = type("", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("", (), {"master": "spark://far:7077"})

    with pytest.raises(RuntimeError):
        Scratch(Far)


# --- valley test ---------------------------------------------------------------------------


def histograms(seed, k):
    r = np.random.default_rng(seed)
    for i in range(k):
        w = int(r.integers(30, 900))
        counts = r.integers(0, 4, w) if i % 4 == 0 else (r.random(w) < 0.05) * r.integers(1, 30, w) if i % 4 == 1 else np.repeat(r.integers(0, 5, w // 7 + 1), 7)[:w] if i % 4 == 2 else np.rint(50 * np.exp(-(((np.arange(w) - r.uniform(0, w)) / (w / 9)) ** 2)) + 40 * np.exp(-(((np.arange(w) - r.uniform(0, w)) / (w / 9)) ** 2))).astype(int)
        counts[[0, -1]] += 1
        yield counts


@pytest.mark.parametrize("plateaus", [False, True])
@pytest.mark.parametrize("least", [4, 1024])
def test_valleys_of_ranges_are_those_of_the_whole(spark, monkeypatch, least, plateaus):
    monkeypatch.setattr(valley, "LEAST_PART", least)
    rows, boxes, want = [], [], {}
    for b, counts in enumerate(histograms(least, 60)):
        low, share = 17 * b - 300, 0.1
        rows += [(b, 1, low + int(j), int(counts[j])) for j in np.flatnonzero(counts)]
        boxes.append((b, 1, low, len(counts), int(counts.sum()), b % 2 == 0))
        want[b] = brute.one_dimension(counts, b % 2 == 0, share, plateaus)
    df = spark.createDataFrame(rows, "block int, dim int, pos int, n bigint")
    with Scratch(spark) as scratch:
        got = {r["block"]: (r["found"], r["further"]) for r in valley.verdicts(df, valley.box_frame(spark, boxes), 0.1, plateaus, scratch.write).collect()}
    assert {b: got.get(b, (False, False)) for b in want} == want
    assert {True, False} == {f for f, _ in want.values()}


def test_valley_of_a_box_as_wide_as_an_int(spark):
    humps = np.concatenate((np.arange(1000) * 400_000, 2**32 - 1 - np.arange(1000)[::-1] * 400_000)) - 2**31
    df = spark.createDataFrame([(0, 0, int(p), 2**40) for p in humps], "block int, dim int, pos int, n bigint")
    got = valley.verdicts(df, valley.box_frame(spark, [(0, 0, -(2**31), 2**32, 2000 * 2**40, True)]), 0.1, True).collect()
    assert [(r["found"], r["further"]) for r in got] == [(True, False)]


# --- many blocks, clusters, pairs ----------------------------------------------------------


def tree(cuts, low, high):
    """Blocks from a list of (block, dim, pos)."""
    blocks, ids = {0: Block(0, summary([low, high]), tuple(low), tuple(high))}, count(1)
    for at, dim, pos in cuts:
        b, (i, j) = blocks[at], (next(ids), next(ids))
        swap = lambda box, v, dim=dim: tuple(v if x == dim else y for x, y in enumerate(box))
        blocks[i], blocks[j] = Block(i, b.summary, b.inf, swap(b.sup, pos), at), Block(j, b.summary, swap(b.inf, pos + 1), b.sup, at)
        b.dim, b.pos, b.children = dim, pos, (i, j)
    return blocks


def leaf_of(blocks, point):
    at = 0
    while blocks[at].children:
        b = blocks[at]
        at = b.children[int(point[b.dim] > b.pos)]
    return at


def check_blocks(spark, blocks, low, high, n=300):
    r = random.Random(1)
    rows = [[r.randint(a - 5, b + 5) for a, b in zip(low, high)] for _ in range(n)]
    df = frame(spark, rows)
    got = df.select("*", clustering.walked_blocks(blocks, df.columns).alias("b")).collect()
    assert [leaf_of(blocks, x) for x in rows] == [x["b"] for x in got]


def test_a_walk_finds_the_leaf(spark):
    r = random.Random(3)
    for trial in range(4):
        low, high, cuts, boxes = [0, -50], [400, 50], [], {0: ([0, -50], [400, 50])}
        ids = count(1)
        for _ in range(r.choice([1, 2, 70, 120])):
            at = r.choice([b for b, (lo, hi) in boxes.items() if any(x < y for x, y in zip(lo, hi))])
            lo, hi = boxes.pop(at)
            dim = r.choice([k for k in (0, 1) if lo[k] < hi[k]])
            pos = r.randint(lo[dim], hi[dim] - 1)
            boxes[next(ids)] = lo, [pos if k == dim else v for k, v in enumerate(hi)]
            boxes[next(ids)] = [pos + 1 if k == dim else v for k, v in enumerate(lo)], hi
            cuts.append((at, dim, pos))
        check_blocks(spark, tree(cuts, low, high), low, high)


def test_twenty_thousand_leaves_and_a_tree_five_thousand_deep(spark):
    deep = tree([(2 * k, 0, k) for k in range(5000)], [0, 0], [6000, 10])
    assert Walk.of(deep).depth <= 24
    check_blocks(spark, deep, [0, 0], [6000, 10])
    even, todo, ids = [], [(0, 0, 0, 2**20, 15)], count(1)
    while len(even) < 20_000:
        at, dim, lo, hi, _ = todo.pop(0)
        mid = (lo + hi) // 2
        even.append((at, 0, mid))
        todo += [(next(ids), 0, lo, mid, 0), (next(ids), 0, mid + 1, hi, 0)]
    blocks = tree(even, [0, 0], [2**20, 9])
    assert sum(b.children is None for b in blocks.values()) == 20_001 and Walk.of(blocks).depth <= 26
    check_blocks(spark, blocks, [0, 0], [2**20, 9])


def nearest(point, centers, rhos, zero):
    best = min(((refine.distance(c, r, point, zero), k) for k, (c, r) in enumerate(zip(centers, rhos))), default=(2, 0))
    return best[1] if best[0] <= 1 else None


@pytest.mark.parametrize("zero", ["exact", "ignore"])
def test_grid_look_ups_equal_the_search_of_all(spark, zero):
    r = np.random.default_rng(4)
    for d, side in ((1, 40), (2, 60), (3, 25)):
        centers = (r.integers(0, 2 * side, (150, d)) / 2).tolist()
        rhos = r.choice([0.0, 1.0, 2.5, 7.0], (150, d)).tolist()
        rows = r.integers(-8, side + 8, (400, d)).tolist() + [[int(c) for c in x] for x in centers[:50]]
        df, cols = frame(spark, rows, d), [f"x{i}" for i in range(d)]
        for entries in (150 * 4, 1 << 18):
            grid = geometry.Grid.of(*refine.ellipse_boxes(np.array(centers), np.array(rhos), zero), entries=entries)
            got = geometry.with_candidates(df, "k", cols, *grid.candidates(cols), centers, rhos, zero).collect()
            assert [x["k"] for x in got] == [nearest(p, centers, rhos, zero) for p in rows]


def test_ten_thousand_clusters(spark):
    r = np.random.default_rng(7)
    places = [(100 * x, 100 * y) for x in range(100) for y in range(100)]
    clusters = [summary([(x + int(a), y + int(b)) for a, b in r.integers(-20, 21, (6, 2))], i) for i, (x, y) in enumerate(places)]
    model = clustering.Model(["x0", "x1"], {}, [], [], clusters, [], clustering.Options())
    rows = r.integers(-150, 10_150, (400, 2)).tolist() + [list(map(int, c.centroid)) for c in clusters[::50]]
    got = [x["label"] for x in model.transform(frame(spark, rows)).collect()]
    centers, rhos = [c.centroid for c in clusters], [[3 * v for v in c.radii] for c in clusters]
    c, s, p = np.array(centers), np.array(rhos), np.array(rows, float)
    d = (((c[None] - p[:, None]) / s[None]) ** 2).sum(2)
    want = np.where(d.min(1) <= 1, d.argmin(1), -1).tolist()
    assert got == want and max(want) > 9000 and -1 in want


def test_listed_and_looked_up_plans_agree(spark, monkeypatch):
    df = frame(spark, blobs())
    a = fit(df, ["x0", "x1"])
    want = [r.asDict() for r in a.block_labels(a.transform(df)).collect()]
    monkeypatch.setattr(clustering, "LISTED", 0)
    b = fit(df, ["x0", "x1"])
    assert b.trace == a.trace and [(s.n, s.ls, s.ss) for s in b.refined] == [(s.n, s.ls, s.ss) for s in a.refined]
    assert [r.asDict() for r in b.block_labels(b.transform(df)).collect()] == want


def all_reachable(blocks, zero):
    out = {}
    for b in blocks:
        out[b.id] = {m.id for m in blocks if not m.is_outlier and (m.id == b.id or refine.distance(m.summary.centroid, [3 * r for r in m.summary.radii], [min(max(x, lo), hi) for x, lo, hi in zip(m.summary.centroid, b.inf, b.sup)], zero) <= 1)}
    return out


def test_the_sweep_reaches_what_all_pairs_reach():
    r = np.random.default_rng(0)
    for _ in range(40):
        blocks = []
        for i in range(25):
            low = r.integers(0, 60, 2)
            rows = np.rint(r.normal(r.integers(0, 80, 2), r.choice([0, 1, 6], 2), (5, 2))).astype(int).tolist()
            blocks.append(Block(i, summary(rows, i), tuple(map(int, low)), tuple(map(int, low + r.integers(0, 40, 2))), is_outlier=bool(r.random() < 0.2)))
        for zero in ("exact", "ignore"):
            assert refine.reachability(blocks, 3.0, zero) == all_reachable(blocks, zero)


def test_twenty_thousand_blocks_without_all_pairs(monkeypatch):
    r, blocks = np.random.default_rng(1), []
    for x in range(142):
        for y in range(142):
            rows = (np.array([100 * x + 50, 100 * y + 50]) + r.integers(-25, 26, (8, 2))).tolist()
            blocks.append(Block(len(blocks), summary(rows), (100 * x, 100 * y), (100 * x + 99, 100 * y + 99)))
    met, sweep = [], refine.overlaps
    monkeypatch.setattr(refine, "overlaps", lambda *a: ((k, met.append(len(at)) or at) for k, at in sweep(*a)))
    got = refine.reachability(blocks)
    assert len(got) == 142**2 and sum(met) < 0.05 * len(blocks) ** 2
    some = r.choice(len(blocks), 30, replace=False).tolist()
    near = [b for b in blocks if any(abs(b.inf[0] - blocks[k].inf[0]) <= 200 and abs(b.inf[1] - blocks[k].inf[1]) <= 200 for k in some)]
    want = all_reachable(near, "exact")
    assert all(got[k] == want[k] for k in some)


def plain_merge(summaries, multiplier):
    """All pairs on a heap at once."""
    live, n = {s.id: s for s in summaries}, sum(s.n for s in summaries)
    whole = summaries[0]
    for s in summaries[1:]:
        whole = whole.plus(s)
    within, k = sum(s.ssq for s in summaries), len(summaries)
    between = whole.ssq - within
    highest = exact.calinski_harabasz(between, within, n, k)
    heap = [(refine.merge_cost(a, b), a.id, b.id) for a, b in combinations(summaries, 2) if refine.admissible(a, b)]
    heapq.heapify(heap)
    ids, steps = count(max(live) + 1), []
    while heap and k > 2:
        cost, i, j = heapq.heappop(heap)
        if i not in live or j not in live:
            continue
        index = exact.calinski_harabasz(between - cost, within + cost, n, k - 1)
        if not index > highest * multiplier:
            break
        made = live.pop(i).plus(live.pop(j), next(ids))
        between, within, k, highest = between - cost, within + cost, k - 1, max(highest, index)
        for other in live.values():
            if refine.admissible(other, made):
                heapq.heappush(heap, (refine.merge_cost(other, made), other.id, made.id))
        live[made.id] = made
        steps.append((i, j, made.id, cost, index))
    return steps


def test_partner_lists_merge_as_the_heap_of_all_pairs():
    r = np.random.default_rng(5)
    longest = 0
    for trial in range(25):
        k = int(r.integers(3, 60))
        grid = r.integers(0, 6, (k, 2)) * 40 if trial % 2 else r.integers(0, 500, (k, 2))  # equal places and equal costs too
        parts = [summary((grid[i] + r.integers(-9, 10, (int(r.integers(1, 9)), 2))).tolist() if trial % 3 else [grid[i].tolist()] * 2, i) for i in range(k)]
        _, steps = refine.merge(parts, 0.3)
        want = plain_merge(parts, 0.3)
        assert [(s["left"], s["right"], s["made"].id, s["cost"], s["index"]) for s in steps] == want
        longest = max(longest, len(want))
    assert longest > 20


def test_many_clusters_merge_in_memory_for_each_not_each_pair():
    r = np.random.default_rng(6)
    parts = [summary((r.integers(0, 200_000, 2) + r.integers(-300, 301, (5, 2))).tolist(), i) for i in range(4000)]
    pairs, most = refine.Partners(parts), 0
    ids = count(4000)
    for _ in range(1500):
        _, i, j = pairs.cheapest()
        pairs.join(i, j, next(ids))
        most = max(most, len(pairs.heap))
    assert most <= 4 * 4000 + 64


# --- first jump ----------------------------------------------------------------------------


def first_jump(values, low, high):
    part = sorted(values)[low : None if high is None else high + 1]
    return part[refine.jump_index(part)] if part else None


def test_jump_threshold_equals_the_sorted_search(spark):
    r = random.Random(12)
    for trial in range(5):
        values = [r.choice([0, 1, 1, 2, 3, 50, r.randint(1, 10**6)]) if trial % 3 else r.randint(5, 9) * 10 ** r.randint(0, 2) for _ in range(r.choice([0, 1, 2, 9, 60]))]
        for low, high in ((0, None), (3, 20)):
            got = stats.jump_threshold(spark.createDataFrame([(v,) for v in [*values, None]], "v bigint"), "v", low, high).first()
            assert got["threshold"] == first_jump(values, low, high), (values, low, high)
    assert math.isclose(stats.jump_threshold(spark.createDataFrame([(1,), (2,), (8,)], "v int"), "v").first()["lim"], 4.0)


def test_cli(spark, tmp_path, capsys, monkeypatch):
    from orogen import __main__

    assert __main__.main([]) == 1 and "missing" in capsys.readouterr().out
    r = np.random.default_rng(2)
    path = tmp_path / "points.txt"
    path.write_text("\n".join(f"{x},{y}" for x, y in np.rint(np.concatenate([r.normal((0, 0), 12, (90, 2)), r.normal((300, 100), 12, (90, 2))])).astype(int).tolist()))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    start = time.monotonic()
    assert __main__.main([str(path)]) == 0 and time.monotonic() > start
    assert "clusters: " in capsys.readouterr().out and spark.read.text(f"{path}.labels").count() == 180
