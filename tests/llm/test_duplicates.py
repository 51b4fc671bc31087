"""Exact, line, SimHash and vector duplicates, components and the pipeline, against brute force."""

import os
import random
import re
from itertools import product

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orogen.llm import entries, exact, langid, lines, shared, simhash, vectors

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "conversations", "labels")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"select {', '.join(cols)} from ({entries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(want, key=repr)


def test_components_on_chains_stars_and_rings(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    links += [(300 + r.randrange(80), 300 + r.randrange(80)) for _ in range(70)] + [(5, 5), (7, 8), (8, 7)]
    r.shuffle(links)
    got = {x["v"]: x["root"] for x in shared.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots(400, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {v: want[v] for v in touched}
    assert shared.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exact_groups(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r["text"]), []).append(r["doc_id"])
    got = exact.exact_groups(odd).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: (max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g}
    assert exact.exact_groups(none).count() == 0


def test_directory_doubling_splits_overfull_buckets(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2000).alias("text"))
    keys, index = exact.build_index(exact.entries(df), capacity=100)
    held = [(r["bucket"], r["depth"], r["keys"]) for r in keys.groupBy("bucket", "depth").agg(F.collect_list("key").alias("keys")).collect()]
    assert sum(len(k) for _, _, k in held) == 2000 and max(len(k) for _, _, k in held) <= 100 and len(held) > 20
    mask = (1 << 64) - 1
    for bucket, depth, own in held:
        assert all(((k & mask) >> (64 - depth)) == ((bucket & mask) >> (64 - depth)) for k in own)
        parent = depth - 1  # doubling stops as soon as a bucket fits
        near = sum(((k & mask) >> (64 - parent)) == ((bucket & mask) >> (64 - parent)) for _, _, ks in held for k in ks)
        assert near > 100
    assert index.count() == 1000 and {r["chain"] for r in index.collect()} == {1}


def test_directory_goes_through_all_bits(spark):
    # keys that differ in their last bits only, next to two far ones
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 200).alias("text"))
    low = lambda norm: F.when(norm == "t7", F.lit(-5)).otherwise(F.substring(norm, 2, 9).cast("bigint"))
    rows = exact.entries(df, key_of=low)
    keys, _ = exact.build_index(rows, capacity=3)
    sizes = [r["count"] for r in keys.groupBy("bucket").count().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 3 and keys.agg(F.max("depth")).first()[0] > 60
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(df, capacity=3, key_of=low).collect()}
    assert got == {i: (max(j for j in (i % 200, i % 200 + 200) if j < 300), 1 + (i % 200 < 100)) for i in range(300)}


def test_pages_stay_near_the_number_of_buckets(spark):
    keys = spark.range(40_000).select(F.xxhash64("id").alias("key"))
    pages = exact.directory(keys, 3)
    buckets = exact.place(keys, pages, 3).select("bucket").distinct().count()
    assert all(p.count() <= 3 * buckets for p in pages) and sum(p.count() for p in pages[1:]) <= buckets
    # keys that share their first 40 bits: the next pages look on below these alone
    close = keys.union(spark.range(500).select((F.lit(77 << 24).cast("bigint") + F.col("id")).alias("key")))
    pages = exact.directory(close, 3)
    held = exact.place(close, pages, 3).groupBy("bucket").count().agg(F.max("count"), F.sum("count")).first()
    assert (held[0] <= 3, held[1]) == (True, 40_500) and all(p.count() <= 3 * buckets for p in pages)


def test_a_text_in_a_third_of_the_rows_is_dealt_in_slices(spark):
    df = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text everywhere', concat('text ', id div 2)) as text")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(held, ("-1", "false", "64")):
        spark.conf.set(k, v)
    try:
        rows = exact.entries(df)
        keys, _ = exact.build_index(rows)
        tasks = [r["count"] for r in exact.deal(rows, keys).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) >= 3000 and max(tasks) < 0.2 * sum(tasks)
        got = exact.exact_groups(df).where("group_size > 2").agg(F.min("keep_id"), F.max("keep_id"), F.count("*"), F.min("group_size")).first()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert tuple(got) == (8997, 8997, 3000, 3000)


@pytest.mark.parametrize("capacity", [1, 512])
def test_different_texts_of_one_key_are_chained(spark, capacity):
    # two keys for all texts: without a comparison of the bytes in the chain, groups would fall together
    texts = ["same"] * 50 + ["Other"] * 7 + ["other"] * 4 + ["x" * 5, "y" * 5, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = exact.exact_groups(df, capacity=capacity, key_of=lambda norm: F.length(norm).cast("bigint") % 2).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: (max(g), len(g)) for g in groups.values() for i in g}
    assert len({(r["bucket"], r["chain"], r["text_sha256"]) for r in got}) == len(groups) == 5
    assert sorted(r["chain"] for r in {r["text_sha256"]: r for r in got}.values()) == [1, 1, 2, 2, 3]


def test_one_text_in_many_rows_is_one_entry(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = exact.exact_groups(df, capacity=1).collect()
    assert {(r["keep_id"], r["group_size"], r["chain"]) for r in got} == {(499, 500, 1)} and sum(r["kept"] for r in got) == 1


def kept_lines(rows):
    """Brute force over (id, text) rows."""
    strip = " \t\n\x0b\x0c\r"
    owner, seen = {}, {}
    order = lambda i: (1 << 63) - 1 if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(strip))
            if len(key) >= 10:
                seen.setdefault(key, set()).add(order(i))
    owner = {k: min(v) for k, v in seen.items() if len(v) > 1}
    return [(i, [x for x in (text or "").split("\n") if owner.get(lower(x.strip(strip)), order(i)) == order(i)], len((text or "").split("\n"))) for i, text in rows]


@pytest.mark.parametrize("hot", [512, 1])
def test_line_dedup(spark, odd, none, hot):
    many = odd.unionByName(odd.select([F.lit(100 + i).cast("bigint").alias("doc_id") if c == "doc_id" else F.lit("\n".join(["a very common line"] * 70 + ["own line number %d" % i])).alias("text") if c == "text" else F.col(c) for c in odd.columns for i in (1,)]).limit(1))
    rows = [(r["doc_id"], r["text"]) for r in many.select("doc_id", "text").collect()] + [(200 + i, "A very common line \nfresh and new %d" % i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("pos", F.lit(1)).withColumn("mark", F.lit(1)).withColumn("word", F.lit(1))
    got = lines.apply_bitmaps(df, lines.line_bitmaps(df, hot_keys=hot))
    want = sorted(((i, n, n - len(k), "\n".join(k)) for i, k, n in kept_lines(rows)), key=repr)
    assert sorted((tuple(r) for r in got.select("doc_id", "_n_lines", "_n_dropped", "_kept_text").collect()), key=repr) == want
    assert got.drop("_n_lines", "_n_dropped", "_kept_text").columns == df.columns
    assert lines.apply_bitmaps(none, lines.line_bitmaps(none)).count() == 0


def test_line_hashes_are_independent(spark):
    """The second hash is taken of the key itself, not of the first hash."""
    df = spark.createDataFrame([(i, "line number %d" % i) for i in range(20)], "doc_id bigint, text string")
    seed = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
    got = {(r["h1"] % (1 << 64), r["h2"] % (1 << 64)) for r in lines.occurrences(df, "doc_id", "text", 10).collect()}
    keys = ["line number %d" % i for i in range(20)]
    assert got == {(xxhash.xxh64_intdigest(k, 42), xxhash.xxh64_intdigest(k, seed)) for k in keys}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def test_golay_code_is_perfect():
    table, over = simhash.coset_table()
    light = np.bitwise_count(table[:, 0])
    assert (table[:, 0] >= 0).all() and light.max() == 3 and len(set(table[:, 0].tolist())) == 2048
    assert ((over == 0).sum(axis=1) == 1).all() and (over[:, 0] == 0).all()


@pytest.mark.parametrize("paired, most", [(False, 5), (True, 4)])
def test_home_anchor_of_one_is_among_those_of_the_other(paired, most):
    """Whatever way the differing bits fall on the three blocks."""
    r = np.random.default_rng(4)
    for split in product(range(most + 1), repeat=3):
        if not 0 < sum(split) <= most:
            continue
        a = r.integers(0, 1 << 64, 40, dtype=np.uint64)
        b = a.copy()
        for i in range(len(b)):
            for n, (low, bits) in zip(split, simhash.BLOCKS):
                for at in r.choice(bits, n, replace=False):
                    b[i] ^= np.uint64(1 << (low + int(at)))
        places = [{}, {}]
        for fps, place, home_only in ((a, places[0], True), (b, places[1], False)):
            for anchor, fp, _ in zip(*(x.tolist() for x in simhash.anchor_rows(fps, paired, home_only))):
                place.setdefault(fp, set()).add(anchor)
        assert all(places[0][int(x)] & places[1][int(y)] for x, y in zip(a, b)), split


@pytest.mark.parametrize("slice_rows, paired", [(8192, False), (20, False), (8192, True), (20, True)])
def test_simhash_links_equal_brute_force(spark, slice_rows, paired):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 120, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for x in base for k in (0, 1, 2, 3, 4, 5)]
    one_place = {int(base[0]) & ((1 << 46) - 1) | int(x) << 46 for x in r.integers(0, 1 << 18, 150)}
    fps = sorted(set(near) | one_place | {(1 << i) - 1 for i in range(0, 60, 3)} | {0, (1 << 64) - 1})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp bigint")
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = roots(len(fps), pairs)
    at = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fps)}
    found = [(at[x["a"]], at[x["b"]]) for x in simhash.links(df, slice_rows=slice_rows, paired=paired).collect()]
    assert roots(len(fps), found) == want
    assert len(found) < 6 * len(fps) * (1 if slice_rows > 100 else 8)


def test_simhash_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    rows = [r for r in docs.collect()]
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    low = {}
    for r, root in zip(rows, want):
        if r["doc_id"] is not None:
            low[root] = min(low.get(root, r["doc_id"]), r["doc_id"])
    expected = sorted(((r["doc_id"], fp, low.get(root)) for r, fp, root in zip(rows, fps, want)), key=repr)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect()), key=repr)
    assert got == expected and simhash.near_groups(none).count() == 0
    two_blocks = simhash.near_groups(docs, paired=True)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in two_blocks.collect()), key=repr) == expected
    assert simhash.near_groups(none, paired=True).count() == 0


@pytest.mark.parametrize("slice_rows, kind", [(4096, "double"), (8, "double"), (4096, "float")])
def test_vectors_equal_brute_force(spark, slice_rows, kind):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 48))
    rows = [x + r.normal(size=48) * s * 0.1 for x in base for s in (0, 0.5, 1, 1.6, 2.4)] + [base[0]] * 40 + [base[1] * 3]
    rows = [x.astype(np.float32).astype(float) for x in rows] if kind == "float" else rows
    data = [(i, [float(v) for v in x]) for i, x in enumerate(rows)]
    odd_ones = [None, [], [0.0] * 48, [float("nan")] * 48, [None] * 48, [float("inf")] + [1.0] * 47, [1.0, 2.0]]
    data += [(len(data) + i, x) for i, x in enumerate(odd_ones)] + [(None, data[0][1])]
    df = spark.createDataFrame(data, f"vec_id bigint, embedding array<{kind}>").withColumn("label", F.lit(1)).withColumn("vec", F.lit(1)).withColumn("n", F.lit(2))
    got = {x["vec_id"]: x for x in vectors.near_vectors(df, slice_rows=slice_rows).collect()}
    assert len(got) == len(data)
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    counts, want = close.sum(1) - 1, roots(len(rows), list(zip(*np.nonzero(close))))
    mine = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (mine <= counts).all() and mine.sum() >= 0.99 * counts.sum()
    assert sum(got[i]["component_id"] == want[i] for i in range(len(rows))) >= 0.99 * len(rows)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(len(rows), len(rows) + len(odd_ones)))
    assert got[None]["n_links"] == 0 and vectors.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_recall_of_vectors_at_every_k(spark, k):
    r = np.random.default_rng(k)
    a = r.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.normal(size=a.shape)
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cos = r.uniform(0.9505, 0.97, 400)[:, None]
    rows = np.concatenate((a, cos * a + np.sqrt(1 - cos**2) * b, r.normal(size=(300, 64))))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {x["vec_id"]: x for x in vectors.near_vectors(df, k=k).collect()}
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    close = (unit @ unit.T >= 0.95) & ~np.eye(len(rows), dtype=bool)
    assert close.sum() == 800
    mine = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (mine <= close.sum(1)).all() and mine.sum() >= 0.99 * close.sum()


def test_vectors_of_extreme_norms(spark):
    rows = [[1e200] * 3, [2e200] * 3, [1e-200] * 3, [1e-200, 0.0, 0.0], [5e-324, 0.0, 0.0], [1e308, -1e308, 0.0], [-3.0, 3.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectors.near_vectors(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_vectors_that_share_an_id(spark):
    """Each vector under a repeated id has its own links; a component is named after its smallest id."""
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.01]), (3, [1.0, 0.0, 0.02]), (9, [0.0, 0.0, 1.0]), (9, [0.0, 0.01, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_vectors(df).collect())
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_hadamard_is_orthonormal():
    h = vectors.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_pipeline_equals_brute_force(spark, odd):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, order = rows, rows.columns
    tagged = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    kept = [r for r in docs.collect() if tagged[r["doc_id"]]["lang_pred"] != "und" and tagged[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE]
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert one.columns == order and sorted(r["doc_id"] for r in one.collect()) == sorted(r["doc_id"] for r in kept)
    two = corpus_pipeline.line_dedup(spark, one, SF)
    want = {i: "\n".join(k) for i, k, _ in kept_lines([(r["doc_id"], r["text"]) for r in kept])}
    assert two.columns == order and {r["doc_id"]: r["text"] for r in two.collect()} == want
    ids = sorted(want)
    sets = []
    for i in ids:
        words = re.split("[ \t-\r]+", lower(want[i]).strip(" \t\n\x0b\x0c\r"))
        sets.append({tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))})
    first = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    three = corpus_pipeline.simhash_dedup(spark, two, SF)
    stay = [i for k, i in enumerate(ids) if first[k] == k]
    assert three.columns == order and sorted(r["doc_id"] for r in three.collect()) == stay
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert sorted(r["doc_id"] for r in got) == stay and all(r["n"] == r["m"] for r in got)


def test_code_type_holds_every_bucket():
    assert vectors.code_type(64, 3) == "<i4" and vectors.code_type(4096, 3) == "<i8" and vectors.code_type(1, 1) == "<i4"


def test_stages_keep_columns_of_any_name(spark, odd):
    names = ["_rid", "_mark", "_keep", "_lines", "_stay", "_n_lines", "_n_dropped", "_kept_text", "_lang_pred", "_score", "_text", "_id", "component_id", "h1", "a.b", "other0"]
    docs = odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *[F.concat(F.lit(f"{n}-"), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(n) for n in names])
    rest = [f"`{n}`" for n in names]
    want = {r["doc_id"]: tuple(r)[1:] for r in docs.select("doc_id", *rest).collect()}
    for stage in (corpus_pipeline.language_id, corpus_pipeline.line_dedup, corpus_pipeline.simhash_dedup):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        found = got.select("doc_id", *rest).collect()
        assert found and all(tuple(r)[1:] == want[r["doc_id"]] for r in found)
    plain = [n for n in names if n not in ("_n_lines", "_n_dropped", "_kept_text", "_lang_pred", "_score")]
    own = lines.apply_bitmaps(docs, lines.line_bitmaps(docs))
    assert set(plain) <= set(own.columns) and own.count() == docs.count()
    assert set(plain) <= set(langid.identify(docs, carry=True).columns)


def test_package_does_not_need_this_one():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(f"{here}/orogen"):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                assert "orogen.llm" not in open(f"{folder}/{f}").read()
