"""BPE, chat formatting, packing, language ID, LM scoring and licence scans."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orogen.llm import bpe, chat, langid, licenses, lm, packing

SF = "/root/testdata/sf0.001"
PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def naive_bpe(enc, piece: bytes):
    ids = [enc.whole[chr(b)] for b in piece]
    while True:
        found = [(enc.rank[a << 20 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 20 | b in enc.rank]
        if not found:
            return ids
        r, i = min(found)
        joined = enc.token_bytes[ids[i]] + enc.token_bytes[ids[i + 1]]
        ids[i : i + 2] = [enc.whole[joined.decode("latin-1")]]


def test_bpe_equals_library_on_random_text(library):
    enc, rank = bpe.encoder(PATH), packing.rank_encoder(PATH)
    r = random.Random(4)
    parts = ["a", "b", " ", "\n", "\t", "'s", "'LL", "é", "世", "١", "1", " the", "  ", ".", "!!", "<|endoftext|>", "\r\n", "aaaa", "\0", "ing", " ", " ", "😀"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert enc.encode(text).tolist() == want == rank.encode(text).tolist()
        assert enc.decode(enc.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_bpe_pieces_equal_merging_pair_by_pair():
    r = random.Random(6)
    for limit in (None, 700, 2048):
        enc = bpe.encoder(PATH, limit)
        for _ in range(300):
            piece = bytes(r.choice(b"aeinorstth \xc3\xa9") for _ in range(r.randint(1, 40)))
            raw, last, out = piece.decode("latin-1"), None, []
            last, at = enc.last_tokens(raw), len(raw) - 1
            while at >= 0:
                out.append(last[at])
                at -= enc.sizes[last[at]]
            assert out[::-1] == naive_bpe(enc, piece)


def test_bpe_operator(spark, odd, none, library):
    for r in bpe.roundtrip(odd, PATH).join(odd.select("doc_id", "text"), "doc_id").collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == (r["text"] or "")
    got = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert got.count() == odd.count() and bpe.roundtrip(none, PATH).count() == 0


def test_offsets_equal_library():
    markers = (chat.START, chat.SEP, chat.END)
    t = Tokenizer.from_file(PATH)
    t.add_special_tokens(list(markers))
    enc, r = packing.rank_encoder(PATH, markers), random.Random(8)
    parts = [*markers, "<|endoftext|>", "a", " the", "  ", "\n", "é", "世界", "😀", "<\\|im_end|>", "'s", "\0", "12", "\t", "ß ß", "\u200d"]
    for _ in range(800):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        want = t.encode(text, add_special_tokens=False)
        ids, offsets = enc.encode_offsets(text)
        assert ids.tolist() == want.ids and [tuple(x) for x in offsets.tolist()] == want.offsets


def test_chat_roundtrip(spark, library):
    hard = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "<", "|", "a<|", "", "é\n\n <|im_start|>assistant<|im_sep|>x", "<|endoftext|>"]
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "<|"]), r.choice([*hard, None])) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(77, t % 3, "assistant", f"turn {t}") for t in range(700)] + [(None, 1, "assistant", "no id"), (5, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(1)).withColumn("sub", F.lit(2))
    parts = chat.format_chats(df, part_turns=16)
    got = {x["conv_id"]: x for x in chat.digests(parts).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 << 62 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    t = Tokenizer.from_file(PATH)
    t.add_special_tokens([chat.START, chat.SEP, chat.END])
    for x in parts.where("conv_id < 40").collect():
        offsets = np.array(t.encode(x["formatted"], add_special_tokens=False).offsets)
        texts = [(m.start(2), m.end(2)) for m in chat.TURN.finditer(x["formatted"]) if m[1] == "assistant" and m[2]]
        want = [any(a < q and p < b for a, b in texts) for p, q in offsets.tolist()]
        assert np.unpackbits(np.frombuffer(x["mask"], np.uint8))[: len(want)].tolist() == want
    for c in (3, 77):
        mine = sorted(parts.where(F.col("conv_id") == c).collect(), key=lambda x: (x["part"], x["sub"]))
        whole = t.encode("".join(x["formatted"] for x in mine), add_special_tokens=False).ids
        assert np.concatenate([np.frombuffer(x["ids"], "<u4") for x in mine]).tolist() == whole
    assert chat.digests(chat.format_chats(df.where("false"))).count() == 0


def test_mask_equals_scan_of_all_tokens():
    r = np.random.default_rng(3)
    cuts = np.unique(r.integers(0, 200, 60))
    offsets = np.stack([cuts[:-1], cuts[1:]], 1)
    spans = [(20, 41), (60, 61), (100, 150)]
    want = [any(a < e and b > s for s, e in spans) for a, b in offsets]
    assert chat.token_mask(offsets, spans).tolist() == want


def check_packing(rows, texts, library, limit=2048):
    """Every id once, gapless sequences within the limit; returns padding over ids."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))]
        n = sum(r["length"] for r in s)
        assert 0 < n <= limit
        total += n
        padding += limit - n if n & (n - 1) else 0
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted(docs[doc_id], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist() == ids
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:i]) for i in range(len(mine))] and mine[0]["doc_tokens"] == len(ids)
    return padding / max(1, total)


def test_packing(spark, odd, none, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_packing(packing.pack(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library) < 0.02
    single = odd.where("doc_id <> 6 or doc_id is null")
    for buffer in (1 << 17, 4096):
        check_packing(packing.pack(single, buffer_tokens=buffer).collect(), [(r["doc_id"], r["text"]) for r in single.collect()], library)
    assert packing.pack(odd).count() > 0 and packing.pack(none).count() == 0


@pytest.mark.parametrize("space", [" ", "\n", "\t"])
def test_two_million_blanks_pack(spark, space):
    text = "a" + space * 2_000_000 + "b"
    want = bpe.encoder(PATH).encode(text)
    got = packing.rank_encoder(PATH).encode(text)
    assert np.array_equal(got, want)
    pieces = packing.pack(spark.createDataFrame([(1, text), (2, space * 1_200_000)], "doc_id bigint, text string")).drop("ids")
    rows = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in rows} == {1, 2} and all(r["n"] == r["all"] for r in rows)
    assert {r["doc_id"]: r["n"] for r in rows}[1] == len(want) + 1


def test_packing_encoder_needs_ids_in_order_of_merges(tmp_path):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][:300][::-1]
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="merges"):
        packing.rank_encoder(str(tmp_path / "v.json"))


def test_packing_cost_is_least():
    r = np.random.default_rng(8)
    for _ in range(60):
        position = np.concatenate(([0], np.cumsum(r.integers(1, 12, 25))))
        penalty = r.integers(0, 5, 26).astype(float)
        best = [0.0]
        for j in range(1, 26):
            options = []
            for i in range(j):
                n = int(position[j] - position[i])
                if n <= 16:
                    options.append(best[i] + 1 + penalty[j] + (0 if n & (n - 1) == 0 else 16 - n))
            best.append(min(options))
        path = packing.choose_cuts(position, penalty, 16, True)
        cost = sum(1 + penalty[j] + (0 if (n := int(position[j] - position[i])) & (n - 1) == 0 else 16 - n) for i, j in zip(path, path[1:]))
        assert path[0] == 0 and path[-1] == 25 and cost == best[-1]


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(bpe.vocabulary_path("piece_bpe_32k.model"))
    r = np.random.default_rng(0)
    logp = np.log(r.dirichlet(np.ones(pieces.size), 2).T)
    words = ["the", "étoile", "a", "世界\U0001f600x", "thinthing"]
    for word, got in zip(words, langid.forward(pieces, words, logp)):
        text = "▁" + word
        total = [np.ones(2)] + [np.zeros(2) for _ in text]
        for end in range(1, len(text) + 1):
            for start in range(end):
                part = text[start:end]
                at = pieces.auto.get(part, None)
                if at is not None:
                    total[end] = total[end] + total[start] * np.exp(logp[at >> langid.SIZE_BITS])
                elif end - start == 1 and part not in pieces.single:
                    total[end] = total[end] + total[start] * np.exp(logp[-1])
        assert np.allclose(got, np.log(total[-1]))


def test_long_words_are_summed_in_bounded_memory(monkeypatch):
    pieces = langid.pieces_of(bpe.vocabulary_path("piece_bpe_32k.model"))
    r = np.random.default_rng(3)
    logp = np.log(r.dirichlet(np.ones(pieces.size), 5).T)
    words = ["thing" * 40 + "世界\U0001f600x", "a", "étoile" * 30, "\U0001f600" * 50, "in"]
    want = langid.forward(pieces, words, logp)
    monkeypatch.setattr(langid, "LONG", 20)
    monkeypatch.setattr(langid, "STATES", 12)
    assert np.allclose(np.concatenate(list(langid.word_losses(pieces, words, logp))), want)


def test_text_without_white_space(spark):
    rows = [(i, "thisisawordofonelanguage" * (4000 if i == 1 else 3), "en") for i in range(20)] + [(20 + i, "ceciestunmotduneautrelangue" * 5, "fr") for i in range(20)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)


def test_expected_counts_are_posterior_means():
    pieces = langid.pieces_of(bpe.vocabulary_path("piece_bpe_32k.model"))
    got = langid.expected_counts(pieces, ["then"], np.array([[2.0]]))[:, 0]
    found, p = {}, 1 / pieces.size

    def walk(rest, used):
        if not rest:
            found[tuple(used)] = p ** len(used)
        for n in range(1, len(rest) + 1):
            at = pieces.auto.get(rest[:n], None)
            if at is not None:
                walk(rest[n:], [*used, at >> langid.SIZE_BITS])

    walk("▁then", [])
    want = np.zeros(pieces.size)
    for used, w in found.items():
        for i in used:
            want[i] += 2 * w / sum(found.values())
    assert np.allclose(got, want)


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    rows = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert all(rows[i]["lang_pred"] == "und" for i in (2, 3, 5, 9)) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.identify(odd, carry=True).drop("_lang_pred", "_score").columns == odd.columns
    assert langid.identify(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_lm_score_equals_direct_counts(spark, odd, none):
    df = odd.withColumn("target", F.col("doc_id").isin(1, 6))
    v, mu = 512, 50.0
    got = lm.score(df, vocabulary=v, mu=mu).collect()
    enc, rows = bpe.encoder(PATH, v), df.select("doc_id", "text", "target").collect()
    def model(target):
        joint = np.zeros((v + 1, v))
        for r in rows:
            ids = enc.encode(r["text"]).astype(int)
            if r["target"] or not target:
                for a, b in zip([v, *ids], ids):
                    joint[a, b] += 1
        prior = (joint.sum(0) + 1) / (joint.sum() + v)
        return -np.log((joint + mu * prior) / (joint.sum(1, keepdims=True) + mu))
    tables, by = (model(True), model(False)), {}
    for r in rows:
        ids = enc.encode(r["text"]).astype(int)
        by[r["doc_id"]] = (len(ids), *(t[[v, *ids[:-1]], ids].mean() if len(ids) else None for t in tables))
    assert len(got) == len(rows)
    for r in got:
        n, t, b = by[r["doc_id"]]
        assert r["n_tokens"] == n
        assert (r["loss_target"] is None) if t is None else np.allclose((r["loss_target"], r["loss_background"]), (t, b), rtol=1e-4)
    assert lm.score(none.withColumn("target", F.lit(True))).count() == 0


def test_licenses(spark, odd, none):
    rows = [
        ("a/b/LICENSE", "Released under the MIT License."), ("a/b/c/d/x.txt", "nothing"), ("a/b/y.txt", "prose\nLicensed under the Apache License, Version 2.0.\nprose " * 3),
        ("a/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/q/z.txt", None), ("top.txt", ""), (None, "Licensed under CC BY-NC 4.0."),
        ("a/b/e/" + "w.txt", "much prose of many words before it licensed under cc by-nc 4.0 and much prose of many words after it " * 2), ("a/b/c/d/x.txt", "nothing"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id bigint, path string, text string").withColumn("folder", F.lit("!"))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["origin"], r["from_folder"]) for r in licenses.scan(df).collect()}
    assert got[0][:3] == ("MIT", "MIT", "own") and got[2][:3] == ("Apache-2.0", "Apache-2.0", "own")
    assert got[1] == got[8] == (None, "MIT", "inherited", "a/b") and got[4] == (None, "GPL-3.0", "inherited", "a")
    assert got[5][2] == "none" and got[6][:3] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own") and got[7][0] == "CC-BY-NC-4.0"
    assert licenses.scan(odd.withColumn("path", F.lit("p/q"))).count() == odd.count() and licenses.scan(none.withColumn("path", F.lit("p"))).count() == 0
