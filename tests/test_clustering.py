import math
import random
from decimal import Decimal

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions import exact
from orogen.operators import refine, stats, valley
from orogen.operators.refine import Summary
from orogen.plans.clustering import Clusterer, fit
from orogen.streaming.scoring import label_stream


def frame(spark, rows, dims=None):
    dims = dims or len(rows[0])
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"x{i} int" for i in range(dims)))


def summary(rows, id=0):
    a = np.array(rows, dtype=object).reshape(len(rows), -1)
    return Summary(len(a), tuple(int(x) for x in a.sum(0)), tuple(int(x) for x in (a * a).sum(0)), id)


def blobs(seed=3, n=800):
    r = np.random.default_rng(seed)
    parts = [r.normal(c, 12, (n, 2)) for c in ((0, 0), (90, 10), (400, 300))]
    return np.rint(np.concatenate(parts)).astype(int).tolist()


def test_tiny_split(spark):
    rows = [(v,) for v in (1, 1, 2, 10, 11, 12)]
    m = stats.marginals(frame(spark, rows), ["x0"])
    got = stats.best_splits(stats.split_candidates(stats.cumulative(m, 1), 1), 1).first()
    assert (got["pos"], got["n1"]) == (2, 3) and math.isclose(got["delta"], 140.16666666666666)
    s = summary(rows)
    assert s.ss == (371,) and math.isclose(s.ssq, 142.83333333333334)
    assert math.isclose(exact.calinski_harabasz(got["delta"], s.ssq - got["delta"], 6, 2), 210.25)
    assert len(fit(frame(spark, rows), ["x0"]).leaves) == 1  # too narrow for a valley


def test_best_split_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(r.randint(-40, 40), r.randint(0, 9)) for _ in range(200)]
    best = max(
        (exact.gain(len(a), summary(a).ls, len(b), summary(b).ls), d, -p)
        for d in (0, 1)
        for p in {x[d] for x in rows}
        if (a := [x for x in rows if x[d] <= p]) and (b := [x for x in rows if x[d] > p])
    )
    got = stats.best_splits(stats.split_candidates(stats.cumulative(stats.marginals(frame(spark, rows), ["x0", "x1"]), 2), 2), 2).first()
    assert math.isclose(got["delta"], best[0]) and (got["dim"], got["pos"]) == (best[1], -best[2])


def test_parts_add_up_and_order_does_not_matter(spark):
    rows = blobs()
    a = fit(frame(spark, rows), ["x0", "x1"])
    random.Random(1).shuffle(rows)
    b = fit(frame(spark, rows).repartition(7), ["x0", "x1"])
    assert [t["pos"] for t in a.trace] == [t["pos"] for t in b.trace] and len(a.clusters) == len(b.clusters) >= 2
    assert sum(x.summary.n for x in a.leaves) == len(rows)
    for x in a.blocks.values():
        if x.children:
            l, r = (a.blocks[i].summary for i in x.children)
            assert l.plus(r).ss == x.summary.ss and math.isclose(x.summary.ssq, l.ssq + r.ssq + exact.gain(l.n, l.ls, r.n, r.ls), rel_tol=1e-9)
    labels = a.transform(frame(spark, rows)).groupBy("label").count().collect()
    assert sum(r["count"] for r in labels) == len(rows)
    blocks = {r["block"]: r["count"] for r in a.block_labels(frame(spark, rows)).groupBy("block").count().collect()}
    assert blocks == {x.id: x.summary.n for x in a.leaves}


def test_identical_points_are_one_cluster(spark):
    m = fit(frame(spark, [(5, 5)] * 20), ["x0", "x1"])
    assert len(m.leaves) == 1


def test_large_coordinates_do_not_overflow(spark):
    got = stats.summaries(frame(spark, [(50_000,), (-50_000,)] * 10), ["x0"]).first()
    assert got["ss0"] == 20 * 50_000**2


def test_full_range_coordinates_are_exact(spark):
    rows = [(2**31 - 1, -(2**31)), (-(2**31), 2**31 - 1), (2**31 - 1, 2**31 - 1)] * 3
    got = stats.summaries(frame(spark, rows), ["x0", "x1"]).first()
    want = summary(rows)
    assert (got["n"], got["ls0"], got["ss0"], got["ss1"]) == (9, want.ls[0], want.ss[0], want.ss[1])
    model = fit(frame(spark, [(x // 64, y // 64) for x, y in rows]), ["x0", "x1"])
    assert sum(b.summary.n for b in model.leaves) == 9 and all(isinstance(v, int) for b in model.leaves for v in b.summary.ss)


def test_wide_sums_split_like_narrow_ones(spark):
    df = frame(spark, blobs(n=60))
    a, b = (stats.best_splits(stats.split_candidates(stats.cumulative(stats.marginals(df, ["x0", "x1"], wide=w), 2), 2), 2).first() for w in (False, True))
    assert [float(x) for x in a] == [float(x) for x in b]


def test_squared_deviations_of_a_billion_points(spark):
    n, m = 10**9, 2**31 - 1
    df = spark.createDataFrame([(n, n // 2, Decimal(n * (m // 4) ** 2))], "n bigint, ls0 bigint, ss0 decimal(38,0)")
    got = df.select(*stats.ssq_columns(1)).first()["ssq"]
    assert math.isclose(got, (n * n * (m // 4) ** 2 - (n // 2) ** 2) / n, rel_tol=1e-15)


def test_wide_histograms_are_tested_in_ranges(spark):
    # 10 million positions: humps at both ends
    rows = spark.range(400_000).selectExpr("cast(pmod(xxhash64(id), 3000000) + case when id % 2 = 0 then 0 else 7000000 end as int) as x0")
    work = Clusterer(["x0"])
    root = work.root(rows)
    blocks = {0: root}
    work.valleys(work.marginals(rows, blocks, [0]), blocks, [0])
    counts = np.zeros(root.sup[0] - root.inf[0] + 1, np.int64)
    for r in rows.groupBy("x0").agg(F.count("*").alias("n")).toPandas().itertuples():
        counts[r.x0 - root.inf[0]] = r.n
    assert blocks[0].marks == [brute.one_dimension(counts, True)]


def test_fit_writes_labels_and_reports(spark, tmp_path, capsys):
    df = frame(spark, blobs(n=100))
    model = fit(df, ["x0", "x1"], labels=str(tmp_path / "labels"), report=True)
    assert spark.read.text(str(tmp_path / "labels")).count() == 300
    assert f"clusters: {model.number_of_clusters}" in capsys.readouterr().out


def test_outlier_rule():
    dense = refine.Block(1, summary([(x, y) for x in range(20) for y in range(20)]), (0, 0), (19, 19))
    assert refine.restricted_box(dense) == ((7, 7), (11, 11))


def test_no_points_and_null_points_raise(spark):
    with pytest.raises(ValueError):
        fit(spark.createDataFrame([], "x0 int"), ["x0"])
    with pytest.raises(ValueError):
        fit(spark.createDataFrame([(1,), (None,)], "x0 int"), ["x0"])


def test_bends_tell_what_the_whole_average_tells():
    r = np.random.default_rng(5)
    for k in range(300):
        w = int(r.integers(40, 400))
        counts = r.integers(0, 4, w) if k % 3 == 0 else (r.random(w) < 0.05) * r.integers(1, 30, w) if k % 3 == 1 else np.repeat(r.integers(0, 5, w // 7 + 1), 7)[:w]
        counts[[0, -1]] += 1
        whole, pos = brute.moving_average(counts, w // 20), np.flatnonzero(counts)
        some, mean = brute.bends(pos, counts[pos], w, w // 20)
        assert math.isclose(mean, whole.mean(), rel_tol=1e-9) and some.max() == whole.max()
        for share in (0.1, 0.3):
            limits = share * whole.mean(), whole.max() - share * whole.mean()
            got, want = ([(m[j], high) for j, high in brute.turning_points(m, *limits)] for m in (some, whole))
            assert got == want


def test_valley_of_a_box_as_wide_as_an_int():
    humps = np.concatenate((np.arange(1000) * 400_000, 2**32 - 1 - np.arange(1000)[::-1] * 400_000))
    assert brute.occupied(humps, np.full(2000, 2**40), 2**32, True, plateaus=True)[0]


def test_valley_and_wide_gap():
    x = np.arange(200)
    humps = np.rint(1000 * np.exp(-(((x - 50.3) / 15) ** 2)) + 830 * np.exp(-(((x - 110.8) / 17) ** 2))).astype(int)
    assert brute.one_dimension(humps, True)[0]
    assert not brute.one_dimension(np.ones(39, int), True)[0]
    apart = np.zeros(400, int)
    apart[20:60], apart[340:380] = 50, 50
    assert not brute.one_dimension(apart, True)[0]  # strict minima: a wide empty gap is flat
    assert brute.one_dimension(apart, True, plateaus=True)[0]
    assert valley.has_valley([(False, True), (True, False)]) and not valley.has_valley([(False, False), (True, False)])
    assert valley.has_valley([(False, False), (True, False)], "any_dim")


def test_moving_average_is_its_definition():
    c = np.random.default_rng(0).integers(0, 9, 97)
    s = 97 // 20
    want = [c[max(0, j - s) : min(96, j + s - 1) + 1].mean() for j in range(97)]
    assert np.allclose(brute.moving_average(c, s), want)


def test_merging_equals_a_search_of_all_pairs():
    r = np.random.default_rng(2)
    for trial in range(12):
        centres = r.integers(0, 900, (4, 2))
        parts = [summary(np.rint(r.normal(centres[i % 4], 25, (40, 2))).astype(int).tolist(), i) for i in range(11)]
        live, n, k = list(parts), 440, 11
        within = sum(s.ssq for s in parts)
        whole = parts[0]
        for s in parts[1:]:
            whole = whole.plus(s)
        highest = best = exact.calinski_harabasz(whole.ssq - within, within, n, k)
        states, made, want = [list(live)], 11, list(live)
        while k > 2:
            pairs = sorted((refine.merge_cost(a, b), a.id, b.id) for i, a in enumerate(live) for b in live[i + 1 :] if refine.admissible(a, b))
            if not pairs:
                break
            cost, i, j = pairs[0]
            index = exact.calinski_harabasz(whole.ssq - within - cost, within + cost, n, k - 1)
            if not index > 0.9 * highest:
                break
            a, b = (next(s for s in live if s.id == x) for x in (i, j))
            live = [s for s in live if s.id not in (i, j)] + [a.plus(b, made)]
            made, k, within, highest = made + 1, k - 1, within + cost, max(highest, index)
            states.append(list(live))
            if index > best:
                best, want = index, list(live)
        got, steps = refine.merge(parts)
        assert len(steps) == len(states) - 1 > 0
        assert sorted((s.n, s.ls, s.ss) for s in got) == sorted((s.n, s.ls, s.ss) for s in want)


def test_merging_counts_every_point_once():
    r = np.random.default_rng(2)
    parts = [summary(np.rint(r.normal(c, 30, (50, 2))).astype(int).tolist(), i) for i, c in enumerate(((0, 0), (10, 5), (20, 0), (900, 900), (910, 905)))]
    got, steps = refine.merge(parts)
    assert sum(s.n for s in got) == 250 and len(got) == 5 - sum(s["kept"] for s in steps) < 5


def test_zero_radius_modes():
    assert refine.distance([5.0], [0.0], [5]) == 0.0 and refine.distance([5.0], [0.0], [6]) == math.inf
    assert refine.distance([5.0], [0.0], [6], "ignore") == 0.0


def test_safe_div():
    assert exact.safe_div(1, 0) == math.inf and math.isnan(exact.safe_div(0, 0)) and exact.safe_div(1, 2) == 0.5


def test_stream_labels(spark, tmp_path):
    rows = frame(spark, blobs())
    model = fit(rows, ["x0", "x1"])
    rows.write.parquet(str(tmp_path / "in"))
    q = label_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), model, str(tmp_path / "check"), name="labels_test")
    q.processAllAvailable()
    q.stop()
    want = {r["label"]: r["count"] for r in model.transform(rows).groupBy("label").count().collect()}
    assert {r["label"]: r["n"] for r in spark.sql("select label, count(*) n from labels_test group by 1").collect()} == want
