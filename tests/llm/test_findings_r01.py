"""Cases of the review: each failed before its finding was settled."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orogen.llm import bpe, licenses, lm, shingles, simhash

SF = "/root/testdata/sf0.01"


def jaccard(a, b, words=5):
    x, y = ({tuple(p[i : i + words]) for i in range(max(1, len(p) - words + 1))} for p in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def near_texts():
    """Texts and a copy of each with every fourth to eleventh group of words changed, all on one line."""
    r = random.Random(5)
    out = []
    for _ in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(160)]
        for gap in (60, 70, 40, 20):
            out.append(" ".join(words))
            out.append(" ".join("changed" if i % gap == gap - 1 else w for i, w in enumerate(words)))
    return out


@pytest.mark.parametrize("slice_bytes", [16 << 20, 3000])
def test_near_groups_link_at_jaccard(spark, slice_bytes):
    texts = near_texts()
    rows = shingles.shingle_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text", 5)
    name = {r["class"]: r["doc_id"] for r in rows.select("class", "doc_id").orderBy(F.desc("doc_id")).collect()}
    from test_duplicates import roots

    want = roots(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8])
    found = [(name[x["a"]], name[x["b"]]) for x in shingles.links(rows, slice_bytes=slice_bytes).collect()]
    same = [(a, b) for a in range(len(texts)) for b in range(a) if texts[a] == texts[b]]
    assert found and roots(len(texts), found + same) == want


def test_sketches_keep_all_near_pairs_and_few_others():
    r = np.random.default_rng(1)
    made = []
    for _ in range(300):
        a = r.integers(0, 1 << 62, 200).astype(np.uint64)
        for share in (0.82, 0.2):  # Jaccard similarity of the second to the first
            n = round(200 * 2 * share / (1 + share))
            b = np.concatenate((a[:n], r.integers(0, 1 << 62, 200 - n).astype(np.uint64)))
            made.append([shingles.bands(np.sort(x))[1] for x in (a, b)])
    got = shingles.alike(np.array(made), np.full((600, 2), 1600), 0.8)
    assert got[0::2].all() and got[1::2].mean() < 0.02
    assert not shingles.alike(np.array(made[:2]), np.array([[1600, 1200]] * 2), 0.8).any()


@pytest.mark.parametrize("n", [3, 700])
def test_plausible_members_of_every_band_size(spark, n):
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 62, 100).astype(np.uint64)) for i in range(n - 1)]
    planes = [shingles.bands(x)[1].tolist() for x in [*sets, sets[0]]]
    rows = [(b, b * 10_000 + i, 800, *p) for b in (5, 6, 9) for i, p in enumerate(planes)] + [(7, 1, 800, *planes[0]), (7, 2, 800, *planes[0])]
    df = spark.createDataFrame(rows, "band bigint, class bigint, size int, s0 bigint, s1 bigint, s2 bigint, s3 bigint").repartition(2, "band").sortWithinPartitions("band")
    got = sorted(map(tuple, shingles.plausible(df, 0.8).collect()))
    assert got == sorted([(b, b * 10_000 + i) for b in (5, 6, 9) for i in (0, n - 1)] + [(7, 1), (7, 2)])


def test_stage_drops_near_copies_over_four_bits(spark):
    texts = near_texts()
    a, b = next((a, b) for a, b in zip(texts[::2], texts[1::2]) if jaccard(a, b) >= 0.8 and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 4)
    docs = spark.createDataFrame([(1, a), (2, b), (3, "a text of its own that stays")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()) == [1, 3]


def test_lm_counts_trigrams_over_the_whole_vocabulary(spark, odd, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 100)
    df = odd.withColumn("target", F.col("doc_id").isin(1, 6))
    rows, enc, mu = df.select("doc_id", "text", "target").collect(), bpe.encoder(bpe.vocabulary_path()), 20.0
    v = enc.size
    assert v > 40_000
    ids = [[v, v, *enc.encode(r["text"]).tolist()] for r in rows]

    def model(target):
        n = Counter()
        for r, x in zip(rows, ids):
            if r["target"] or not target:
                for a, b, c in zip(x, x[1:], x[2:]):
                    n.update([(a, b, c), (b, c), (c,), ("before", a, b), ("before", b), "all"])

        def loss(a, b, c):
            one = (n[c,] + 1) / (n["all"] + v)
            two = (n[b, c] + mu * one) / (n["before", b] + mu)
            return -np.log((n[a, b, c] + mu * two) / (n["before", a, b] + mu))

        return loss

    models = model(True), model(False)
    want = sorted(((r["doc_id"], len(x) - 2, *(np.mean([m(*t) for t in zip(x, x[1:], x[2:])]) if len(x) > 2 else None for m in models)) for r, x in zip(rows, ids)), key=repr)
    got = sorted((tuple(r) for r in lm.score(df, mu=mu, order=3).select("doc_id", "n_tokens", "loss_target", "loss_background").collect()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (g[2:] == w[2:] if w[2] is None else np.allclose(g[2:], w[2:], rtol=1e-4))


def test_licenses_over_line_breaks_and_whole_texts(spark):
    whole = dict(licenses.TEXTS)
    header = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n"
    cases = [
        ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"),
        ("BSD-3-Clause", "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."),
        ("GPL-3.0", "GNU General Public License,\nversion 3."),
        ("GPL-3.0", header),
        ("AGPL-3.0", header.replace("GNU General", "GNU Affero General")),
        ("MIT", "MIT License"),
        *whole.items(),
    ]
    filler = "words of no licence stand here " * 3
    rows = [(i, f"d{i}/a.txt", t) for i, (_, t) in enumerate(cases)] + [(100 + i, f"d{100 + i}/b.txt", f"{filler}\n{t}\n{filler}") for i, (_, t) in enumerate(cases)]
    rows += [(1000 + i, f"e/{i}.txt", "nothing of note " * 9) for i in range(60)] + [(2000, "d6/x.txt", "no notice")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    for i, (want, _) in enumerate(cases):
        assert got[i]["own_license"] == want, (i, want, got[i])
        assert got[100 + i]["own_license"] == want, (i, want, got[100 + i])
    assert all(got[1000 + i]["own_license"] is None for i in range(60)) and got[2000]["license"] == cases[6][0]


def test_all_matched_stretches_count():
    one = "Licensed under the Apache License, Version 2.0"
    _, _, matched, total = licenses.Matcher(10, {}).text(f"{one}\nfirst filler words\n{one}\nmore filler words\n{one}", 0.8)
    assert matched == 21 and total == 27


def test_document_frequencies_are_those_of_all_texts(spark):
    texts = ["Version 4.0.", "see 4.0; a license.", "“license” and the.", None, "the the", "...license... 4.0.-"]
    n, got = licenses.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = Counter(w for t in texts for w in set(licenses.words_of(t or "")) & licenses.VOCABULARY)
    assert n == 6 and got == want and got["4.0"] == 3 and got["license"] == 3


def test_stage_keeps_one_row_of_each_group(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    near = a.replace("a99", "other")
    rows = [(1, a), (5, near), (5, b), (7, "twice the same text"), (7, "twice the same text"), (None, a), (None, near), (None, "no id"), (None, "no id"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["text"] or "") for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (7, "twice the same text"), (None, "no id"), (9, "")], key=repr)
