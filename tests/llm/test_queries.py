"""The registered queries without SQL, on the smallest tables, against brute force or the library."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orogen.llm import bpe, entries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    return {i: (library.encode(t, add_special_tokens=False).ids, library) for i, t in texts.items()}


def test_op2_targets_are_the_good_labels(spark, ids):
    got = {r["doc_id"]: r for r in entries.op2_lm_score(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    assert set(got) == set(ids) and {i for i, r in got.items() if r["target"]} == good & set(ids)
    assert all(r["n_tokens"] == len(ids[i][0]) for i, r in got.items())
    assert all(r["loss_difference"] == r["loss_target"] - r["loss_background"] for r in got.values() if r["n_tokens"])


def test_op4_equals_the_library(spark, ids):
    for r in entries.op4_bpe(spark, SF).collect():
        want, library = ids[r["doc_id"]]
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_op5_places_every_id_once(spark, ids):
    pieces, sequences = {}, {}
    for r in entries.op5_packing(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(ids)
    for i, rows in pieces.items():
        want, at = [*ids[i][0], 1], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            part = want[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.03 * sum(len(x) + 1 for x, _ in ids.values()) + 2048 * 8


def test_op3_paths_and_op8_to_op10_rows(spark, texts):
    got = entries.op3_licenses(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    unit = np.array([vectors[i] for i in sorted(vectors)], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    found = {r["vec_id"]: r["n_links"] for r in entries.op8_near_vectors(spark, SF).collect()}
    assert [found[i] for i in sorted(vectors)] == links.tolist()
    langs = entries.op10_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in langs) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in langs)
