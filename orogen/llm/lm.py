"""Cross-entropy difference between a target and a background n-gram model.

Both models share one closed vocabulary, all ids of a public byte-level BPE (or its first ``vocabulary``),
in which every text can be written, and have the same order and smoothing:
``p(c|a,b) = (n(a,b,c) + mu p(c|b)) / (n(a,b) + mu)``, so down to ``p(c) = (n(c) + 1) / (n + vocabulary)``. The
background is counted over all documents, the target over those that are marked; nothing
is sampled and no n-gram is left out, so the tables grow with the input.

1. Texts are encoded once; chunks of documents (about ``CHUNK`` bytes of text) go to the shared folder.
2. Each chunk's distinct n-grams with their counts are dealt to buckets by the hash of their context. There are
   as many buckets as chunks ask for, so that the mean size of a bucket stays the same as the input grows; what follows a very
   frequent context is in one bucket, which grows. A chunk has a row for each bucket in which it has n-grams: rows grow faster than the
   input until a row holds a single n-gram.
3. A bucket's owner adds them up: its part of the table. It answers each chunk with the sums of what the chunk
   holds, so that no document needs the table; only sums of single ids (bounded by the vocabulary) are broadcast.
4. Chunks meet their answers and score their documents: mean loss per token under the target minus
   that under the background (lower: more like the target).

Cases: null and empty texts have no tokens and null losses; without target documents
the target model is the uniform one; repeated rows count as often as they occur; an empty table gives an
empty table; null ids are scored and never targets; other input columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.bpe import encoder, small_batches, vocabulary_path
from orogen.llm.shared import arrow_map, materialise, release

CHUNK = 4 << 20
#: Chunks whose n-grams one bucket can hold.
BUCKET_CHUNKS = 8
ID_BITS = 17
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view("<u8")


def size_of(path: str) -> int:
    """Number of ids of a vocabulary file."""
    spec = json.loads(open(path, encoding="utf-8").read())
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def encoded(df: DataFrame, path: str, limit: int | None, id_col: str, text_col: str, target_col: str) -> DataFrame:
    """``chunk, doc_id, target, n`` (arrays, one element a document) and ``ids`` of all of them, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, number = encoder(path, limit), TaskContext.get().partitionId() << 32
        docs, targets, ids, size = [], [], [], 0

        def chunk():
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
            columns = [pa.array([number]), pa.array([docs], pa.list_(pa.int64())), pa.array([targets], pa.list_(pa.bool_())), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([packed(flat)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "target", "n", "ids"])

        for batch in small_batches(batches, 2):
            for doc, target, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs.append(doc)
                targets.append(target)
                ids.append(enc.encode(text))
                size += 16 + len(text or "")
                if size >= CHUNK:
                    yield chunk()
                    number, docs, targets, ids, size = number + 1, [], [], [], 0
        if docs:
            yield chunk()

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(target_col).cast("boolean"), F.lit(False)).alias("target"), F.col(text_col).cast("string").alias("text"))
    return materialise(arrow_map(rows, run, "chunk bigint, doc_id array<bigint>, target array<boolean>, n array<bigint>, ids binary"), "lm-ids")


def ngrams(ids: np.ndarray, n: np.ndarray, vocabulary: int, order: int) -> Iterator[np.ndarray]:
    """Keys of the n-grams that end at each id, for orders 2 to ``order``; ``vocabulary`` stands before a document's first id."""
    ids = ids.astype(np.uint64)
    start = np.repeat(np.cumsum(n) - n, n)
    at, key = np.arange(len(ids)), ids.copy()
    for k in range(1, order):
        before = np.where(at - k >= start, ids[np.maximum(at - k, 0)], np.uint64(vocabulary))
        key |= before << np.uint64(k * ID_BITS)
        yield key | np.uint64(k << (3 * ID_BITS))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By context, so that one bucket has all that follows it."""
    found = (((keys >> np.uint64(ID_BITS)) * SPREAD) >> np.uint64(33)) % np.uint64(buckets)
    return found.astype(np.uint16 if buckets < 1 << 16 else np.uint32)  # narrow numbers sort faster


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys, bucket by bucket, and where each bucket begins."""
    own = bucket_of(keys, buckets)
    return np.argsort(own, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(own, minlength=buckets))))


def single_counts(chunks: DataFrame, vocabulary: int) -> np.ndarray:
    """Counts of the ids under target and background."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, vocabulary), np.int64)
        for batch in batches:
            for target, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = unpacked(raw).astype(np.int64)
                sums[0] += np.bincount(ids[np.repeat(target, n).astype(bool)], minlength=vocabulary)
                sums[1] += np.bincount(ids, minlength=vocabulary)
        hit = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[0, hit]), pa.array(sums[1, hit])], names=["id", "n_target", "n_background"])

    found = arrow_map(chunks.select("target", "n", "ids"), run, "id bigint, n_target bigint, n_background bigint")
    found = found.groupBy("id").agg(F.sum("n_target").alias("n_target"), F.sum("n_background").alias("n_background")).toPandas()
    out = np.zeros((2, vocabulary))
    out[:, found["id"].to_numpy(np.int64)] = found[["n_target", "n_background"]].to_numpy(float).T
    return out


def ngram_counts(chunks: DataFrame, vocabulary: int, order: int, buckets: int) -> DataFrame:
    """``bucket, chunk, sums``: for each chunk the sums of its keys in the bucket, in order of the keys."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("lm counts")  # the encoder is done
        for batch in batches:
            for chunk, target, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                mark, found = np.repeat(np.array(target, np.uint64), n), []
                for level in ngrams(unpacked(raw), np.array(n, np.int64), vocabulary, order):
                    flat = np.sort(level << np.uint64(1) | mark)
                    first = np.flatnonzero(np.diff(flat >> np.uint64(1), prepend=np.uint64(0)))
                    if len(first):
                        found.append((flat[first] >> np.uint64(1), np.add.reduceat(flat & np.uint64(1), first), np.diff(first, append=len(flat))))
                if not found:
                    continue
                keys, marked, count = map(np.concatenate, zip(*found))
                by, edge = by_bucket(keys, buckets)
                rows = [(b, by[edge[b] : edge[b + 1]]) for b in range(buckets) if edge[b] < edge[b + 1]]
                columns = [pa.array([b for b, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64())]
                columns += [pa.array([packed(x) for x in part], pa.binary()) for part in ([np.diff(keys[i], prepend=np.uint64(0)) for _, i in rows], [np.concatenate((marked[i], count[i])) for _, i in rows])]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("lm counts")
        held, names, keys, counts = None, [], [], []

        def answers():
            all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.stack([np.bincount(at, np.concatenate([c[i] for c in counts]), len(all_keys)) for i in (0, 1)])
            first = np.flatnonzero(np.diff(all_keys >> np.uint64(ID_BITS), prepend=np.uint64(0)))
            size = np.diff(first, append=len(all_keys))
            full = np.concatenate((sums, np.repeat(np.add.reduceat(sums, first, axis=1), size, axis=1)))
            low = 0
            for name, k in zip(names, keys):
                mine = full[:, at[low : low + len(k)]]
                low += len(k)
                yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([name]), pa.array([packed(mine.reshape(-1))], pa.binary())], names=["bucket", "chunk", "sums"])

        for batch in batches:
            for b, chunk, k, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != held:
                    if keys:
                        yield from answers()
                    held, names, keys, counts = b, [], [], []
                names.append(chunk)
                keys.append(np.cumsum(unpacked(k), dtype=np.uint64))
                counts.append(unpacked(c).reshape(2, -1))
        if keys:
            yield from answers()

    rows = arrow_map(chunks.select("chunk", "target", "n", "ids"), spread, "bucket bigint, chunk bigint, keys binary, counts binary")
    rows = rows.repartition(min(buckets, 4096), "bucket").sortWithinPartitions("bucket", "chunk")
    return arrow_map(rows, add, "bucket bigint, chunk bigint, sums binary")


def score(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", target_col: str = "target", vocabulary: int | None = None, mu: float = 200.0, order: int = 2) -> DataFrame:
    """``doc_id, target, n_tokens, loss_target, loss_background, loss_difference`` (per token) of every row."""
    if order not in (2, 3):
        raise ValueError("order: 2 or 3")
    path = path or vocabulary_path()
    limit, vocabulary = vocabulary, vocabulary or size_of(path)
    if not 256 <= vocabulary < 1 << ID_BITS:
        raise ValueError("vocabulary: 256 (all bytes) to 131071 (so that three ids fit a key)")
    chunks = encoded(df, path, limit, id_col, text_col, target_col)
    buckets = max(32, -(-chunks.count() // BUCKET_CHUNKS))
    single = single_counts(chunks, vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((single + 1) / (single.sum(axis=1, keepdims=True) + vocabulary))
    answers = ngram_counts(chunks, vocabulary, order, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("lm counts")
        prior, doc, sums = shared.value, None, []

        def scores():
            docs, target, n, raw = doc
            ids, n = unpacked(raw).astype(np.int64), np.array(n, np.int64)
            held = [(b, unpacked(s).reshape(4, -1).astype(np.float32)) for b, s in sums]
            sums.clear()
            used = np.zeros(buckets, np.int64)
            p = prior[:, ids]
            for level in ngrams(ids, n, vocabulary, order):  # a bucket answers order by order, as keys sort
                keys, at = np.unique(level, return_inverse=True)
                by, edge = by_bucket(keys, buckets)
                full = np.zeros((4, len(keys)), np.float32)
                for b, s in held:
                    full[:, by[edge[b] : edge[b + 1]]] = s[:, used[b] : used[b] + edge[b + 1] - edge[b]]
                used += np.diff(edge)
                for i in (0, 1):
                    p[i] = (full[i, at] + mu * p[i]) / (full[2 + i, at] + mu)
            end, mean = np.cumsum(n), []
            for i in (0, 1):
                loss = np.concatenate(([0.0], np.cumsum(-np.log(p[i]))))
                mean.append((loss[end] - loss[end - n]) / np.maximum(n, 1))
            columns = [pa.array(docs, pa.int64()), pa.array(target, pa.bool_()), pa.array(n), *(pa.array(m, pa.float64(), mask=n == 0) for m in mean)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "target", "n_tokens", "loss_target", "loss_background"])

        for batch in batches:
            for bucket, s, *rest in zip(*(batch.column(i).to_pylist() for i in range(1, 7))):
                if bucket < 0:  # a chunk's own row comes first
                    if doc:
                        yield scores()
                    doc, sums = rest, []
                else:
                    sums.append((bucket, s))
        if doc:
            yield scores()

    own = chunks.select("chunk", F.lit(-1).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("sums"), "doc_id", "target", "n", "ids")
    rows = own.unionByName(answers.select("chunk", "bucket", "sums"), allowMissingColumns=True)
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    found = arrow_map(rows, run, "doc_id bigint, target boolean, n_tokens bigint, loss_target double, loss_background double")
    return found.withColumn("loss_difference", F.col("loss_target") - F.col("loss_background"))
