"""Source divergence, whitening and mixing against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.llm import divergence, entries, mixing, whitening

SF = "/root/testdata/sf0.01"


def frame(rows, cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_mixing"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    df = entries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"select {', '.join(cols)} from ({entries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(want, key=repr)


# --- source divergence ---------------------------------------------------------------------


def audited(rows, least, top):
    """By definition, from (lang, source, text) rows."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, found = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        found[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in found.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        p = {}
        for s in [*sources, None]:
            n = {t: sum(counts[lang, x][t] for x in (sources if s is None else [s])) for t in kept}
            p[s] = {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * v) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            out += [(lang, s, "pair", o.decode(), -d, i) for i, (d, o) in enumerate(pairs, 1)]
            terms = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t.decode(), -d, i) for i, (d, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def test_audit_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PART_BYTES", 50)  # only of the driver; the workers' own test is below
    r = random.Random(4)
    words = ["Haus", "der", "élan", "été", "don", "t", "世界", "zwölf", "A", "b", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "S2", "ö", None, *(f"x{i}" for i in range(12))]), " ".join(r.choices(words, range(1, len(words) + 1), k=r.randint(0, 30))) + r.choice(["", ".", "'s 42", "\x00@["])) for _ in range(700)]
    rows += [("en", "s1", None), ("xx", "alone", "word"), ("xx", "other", "  "), ("yy", "single", "a")] + [("en", "s1", "copy Copy COPY")] * 40
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("n", "term", "value", "v", "p", "item")})
    for least, top in ((1, 3), (6, 50), (30, 50), (10**6, 50)):
        got = divergence.audit(df.repartition(5), least_docs=least, top=top)
        assert sorted(map(tuple, got.collect())) == audited(rows, least, top)


def test_rows_that_repeat_an_id_are_one_document(spark, tmp_path):
    rows = [(i, "en", f"s{i % 2}", "often") for i in range(30)]
    rows += [(100 + i % 29, "en", "s0", "Copies copies") for i in range(60)]  # 29 documents on 60 rows
    rows += [(200 + i // 2, "en", f"s{i % 2}", f"halves {'left right'.split()[i % 2]}") for i in range(60)]  # 30 documents, each on rows of both sources
    rows += [(200 + i, "de", "s0", "halves") for i in range(30)]
    rows += [(None, "en", "s1", "nameless") for _ in range(40)] + [(300 + i, "en", "s1", "nameless") for i in range(28)]  # null ids are one document: 29
    rows += [(None, "de", "s1", "ohne") for _ in range(3)] + [(400 + i, "de", "s1", "ohne") for i in range(29)]  # 30
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    kept = {"en": {"often", "halves", "left", "right"}, "de": {"halves", "ohne"}}
    # by rows all kept terms are in 30 documents at least; texts without the others give the result
    want = [(lang, source, " ".join(t for t in text.lower().split() if t in kept[lang])) for _, lang, source, text in rows]
    got = entries.op11_source_divergence(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == audited(want, 30, 50)


def test_terms_of_long_texts_come_in_parts(monkeypatch):
    r = random.Random(9)
    text = "".join(r.choice(["a", "B", "é", " ", "\n", "7", "世"]) for _ in range(5000)).encode()
    whole = text.translate(divergence._TERM).split()
    for size in (1, 7, 100, 4999, 10**6):
        monkeypatch.setattr(divergence, "PART_BYTES", size)
        assert [t for part in divergence.split_terms(text) for t in part] == whole


def test_tasks_hand_on_full_tables(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "ENTRIES", 5)
    monkeypatch.setattr(divergence, "CELLS", 10)
    r = random.Random(2)
    docs = [(r.choice("xy"), r.choice("st"), " ".join(r.choices("abcdefgh", k=9)).encode()) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs]), pa.array([d[2] for d in docs])], names=list("lst"))
    got, want = Counter(), Counter()
    for b in divergence._count(iter([batch.slice(0, 20), batch.slice(20)])):
        for x in b.to_pylist():
            got[x["lang"], x["source"], x["term"], "n"] += x["n"]
            got[x["lang"], x["source"], x["term"], "docs"] += x["docs"]
    for lang, source, text in docs:
        for t, n in Counter(text.split()).items():
            want[lang, source, t, "n"] += n
            want[lang, source, t, "docs"] += 1
    assert got == want
    vectors = [[{"source": s, "n": 1, "p": r.randint(1, 99), "zero": z} for s, z in zip("abcde", (3, 5, 7, 9, 11)) if r.random() < 0.7] for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r.choice("xy") for _ in vectors]), pa.array([r.randint(1, 4) for _ in vectors]), pa.array(vectors)], names=["lang", "times", "v"])
    got, want = Counter(), Counter()
    for b in divergence._pairs(iter([batch.slice(0, 33), batch.slice(33)])):
        for x in b.to_pylist():
            got[x["lang"], frozenset(x["a"] + x["b"])] += x["value"]
    for x in batch.to_pylist():
        for a, b in permutations(x["v"], 2):
            if a["source"] < b["source"]:
                want[x["lang"], frozenset(a["source"] + b["source"])] += x["times"] * (abs(a["p"] - b["p"]) - abs(a["p"] - b["zero"]) - abs(b["p"] - a["zero"]) + abs(a["zero"] - b["zero"]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# --- whitening -----------------------------------------------------------------------------


def whitened(vectors, k=4):
    """From float vectors of one width: n, deviations, eigenvalues, components and trace of the distinct whole-number rows."""
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64) + 0
    u = np.unique(x, axis=0)
    n, s = len(u), [sum(map(int, c)) for c in u.T]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x]
    c = u - u.mean(0)
    values, turn = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return n, deviation, values[order], turn[:, order], values.sum(), x - u.mean(0)


def same_whitening(rows, vectors, ids, k=4):
    n, deviation, values, turn, trace, centred = whitened(vectors, k)
    want = centred @ turn / np.sqrt(values)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(got) == k * len(ids)
    for c in range(k):
        column = np.array([got[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(column @ want[:, c])
        assert np.abs(column * sign - want[:, c]).max() < 1e-7
        for i, d in zip(ids, deviation):
            r = got[i, c + 1]
            assert r["n"] == n and r["deviation"] == d and math.isclose(r["explained"], values[c] / trace, rel_tol=1e-9) and r["identity_error"] < 1e-8


def test_op12_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    same_whitening(entries.op12_whitening(spark, SF).collect(), [r["embedding"] for r in table], [r["vec_id"] for r in table])


def test_clear_spectra_settle_without_the_full_dimension(spark):
    r = np.random.default_rng(3)
    scales = np.concatenate(([900, 500, 200, 80], np.full(36, 1e-3)))
    turn = np.linalg.qr(r.standard_normal((40, 40)))[0]
    vectors = ((r.standard_normal((300, 40)) * scales) @ turn + 1000).tolist()
    rows = whitening.whole_numbers(spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>"), "vec_id", "embedding", 256)
    model = whitening.fit(rows.select("x").distinct(), 40)
    assert not model.expanded and model.passes <= 4
    same_whitening(model.transform(rows).collect(), vectors, range(300))
    flat = whitening.fit(rows.select("x").distinct(), 40, passes=1)
    assert flat.expanded and np.allclose(flat.values, model.values, rtol=1e-12)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(8)
    good = [[r.uniform(-3, 3) for _ in range(w)] for w in (3, 3, 3, 2, 5, 5, 1, 0, 4, 5, 5)]
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (None, good[0]), (50, None), (51, [1.0, None]), (52, [nan]), (53, [inf, 1.0]), (54, [-0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "n", "component", "whitened")})
    got = whitening.whiten(df).collect()
    sound = [(i, v + [0.0] * (5 - len(v))) for i, v in rows[: len(good) + 2] + rows[-1:]]
    n, deviation, *_ = whitened([v for _, v in sound])
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got) == Counter({k: 4 * c for k, c in Counter(zip([i for i, _ in sound], deviation)).items()})
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    assert len({r["whitened"] for r in got if r["vec_id"] == 3 and r["component"] == 1}) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = whitening.whiten(df)
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_few_directions_and_wide_numbers(spark):
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 0.0]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id bigint, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and {round(r["explained"], 9) for r in got} == {1.0}
    wide = [(i, [1e12 * (i - 3), 1e9 * (i * i % 5), float(i)]) for i in range(9)]
    df = spark.createDataFrame(wide, "vec_id bigint, embedding array<double>")
    n, deviation, *_ = whitened([v for _, v in wide], 2)
    assert {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df).collect()} == dict(enumerate(deviation))


# --- mixing --------------------------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling by definition: stop sources above their most, reshare, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped = set()
    while True:
        left, free = sum(sizes.values()) - sum(most * sizes[s] for s in stopped), sum(weight[s] for s in sizes if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else weight[s] * left / free for s in sizes}
        over = {s for s in sizes if s not in stopped and target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


def check_mix(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in ("size", "key", "h", "taken", "slot", "start")})
    got = mixing.taken(df.repartition(3), **options).collect()
    again = mixing.taken(df.repartition(7), **options).collect()
    assert frame(got, got[0].asDict()) == frame(again, got[0].asDict())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((i, size(t)) for i, t, _ in rows) == Counter((r["doc_id"], r["size"]) for r in got)
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    want = targets(totals)
    by = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = by[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == totals[s] and math.isclose(r["target"], want[s], rel_tol=1e-12)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in totals)
    return df


def test_mix_meets_its_targets(spark):
    r = random.Random(6)
    names = ["a", "B", "é", "", None, "z1", "z2", "世"]
    rows = [(i, r.choice([" ", "\n\t", "\x0b"]).join(["w x"] * r.choice([0, 1, 3, 40, 900])) + r.choice(["", " "]), r.choices(names, [50, 9, 9, 3, 9, 1, 1, 20])[0]) for i in range(400)]
    rows += [(1000, None, "null text"), (1001, "  \n", "blank"), (1002, "one", "tiny"), (1003, "very " * 30_000, "a")]
    df = check_mix(spark, rows)
    check_mix(spark, rows, block=7)
    pieces, order, sources = mixing.mix(df, block=64)
    pieces = pieces.collect()
    goal = {s["key"]: s["goal"] for s in sources.collect()}
    blocks, places = defaultdict(int), defaultdict(set)
    for p in pieces:
        blocks[p["slot"], p["key"], p["block"]] += p["length"]
        places[p["key"], p["block"]].add(p["slot"])
    assert all(len(s) == 1 for s in places.values()) and len({s for s, *_ in blocks}) >= 0.9 * len(blocks)
    assert all(n == min(64, goal[k] - 64 * b) for (_, k, b), n in blocks.items())
    # any stretch of the schedule holds each source's part of it
    first = Counter()
    for (slot, key, _), _ in blocks.items():
        first[key] += slot < len(blocks) // 3
    every = sum(-(-g // 64) for g in goal.values())
    assert all(abs(first[k] - len(blocks) // 3 * goal[k] / sum(goal.values())) < 8 for k in goal), every


def test_ranges_and_chunks_add_up(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    monkeypatch.setattr(mixing, "CHUNK_BITS", 3)
    check_mix(spark, [(i, "w " * (i % 13), "xyz"[i % 7 % 3]) for i in range(300)], block=5)


def test_mix_of_nothing_and_of_repeats(spark):
    schema = "doc_id bigint, text string, source string"
    assert mixing.taken(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.taken(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert frame(rows, ["doc_id", "size", "source_size", "target", "taken"]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    rows = mixing.taken(spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, "c", "s"), (None, None, "s"), (None, "d e f", "t")], schema)).collect()
    assert frame(rows, ["doc_id", "size"]) == sorted([(1, 2)] * 3 + [(None, 1), (None, 0), (None, 3)], key=repr)
    assert sum(r["taken"] for r in rows) == 10
