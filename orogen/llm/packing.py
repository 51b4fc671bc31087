"""Order-preserving packing of documents into sequences by dynamic programming.

Documents are taken in the order the table stores them. Each task lays the ids of its
documents end to end and chooses where to cut the line into windows of at most
``max_tokens``. Cuts are free at document ends, cost ``sentence_penalty`` at sentence
ends and ``inner_penalty`` elsewhere (offered only where sentences are long). A window
costs its padding plus one. The best cost of a cut is the least over the cuts at most
one window before it, which a monotone queue keeps; windows whose length is a power of
two need no padding and are tried as well.

A task holds ``buffer_tokens`` at a time: when they are full, the windows of the best
path are emitted and the open tail is carried on, so memory is bounded by the buffer and
the largest document. There is no shuffle; a lost task is simply run again, with the
same windows and the same ``sequence_id`` (task number and running number).

Cases: a null or empty text is a document of the end id alone; runs of white space may have any length; the
vocabulary's special token inside a text gives its own id; repeated rows are packed as
often as they occur; a null ``doc_id`` stays null; an empty table gives an empty table;
other input columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.bpe import PATTERN, ChunkedEncoder, Chunks, read_vocabulary, small_batches, vocabulary_path
from orogen.llm.shared import arrow_map, worker_table

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class RankEncoder(ChunkedEncoder):
    """The ids of a byte-level vocabulary file whose ids count up in the order of its merges.

    Merging the lowest id first is then the file's own order, which a native library does piece by piece. Texts
    are always split here: the library's own split pattern exhausts its stack on a long run of white space.
    """

    def __init__(self, path: str, markers: tuple[str, ...] = ()):
        import tiktoken

        special, raw, merges = read_vocabulary(path)
        ids = {b: i for i, b in raw.items()}
        made = [ids[x + y] for x, y in merges if x + y in ids]
        if any(a > b for a, b in zip(made, made[1:])):
            raise ValueError("ids do not count up in the order of the merges")
        super().__init__(special, raw, markers)
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self.single = self.library._core_bpe.encode_single_piece
        self.split = regex.compile(PATTERN)
        self.pieces = Chunks(self.simple_piece)
        self.token_bytes = [raw.get(i, b"") for i in range(self.size)]

    def simple_piece(self, piece: str) -> bytes:
        return array(self.code, self.single(piece.encode())).tobytes()

    def whole_text(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split.findall(text)])


_loaded: dict[tuple, RankEncoder] = worker_table("packing", "chat")


def rank_encoder(path: str, markers: tuple[str, ...] = ()) -> RankEncoder:
    """The worker's encoder for a vocabulary file and markers."""
    if (path, markers) not in _loaded:
        _loaded[path, markers] = RankEncoder(path, markers)
    return _loaded[path, markers]


def choose_cuts(position: np.ndarray, penalty: np.ndarray, max_tokens: int, close: bool) -> list[int]:
    """Indices of the chosen cuts, the first and the last included.

    ``position`` rises from 0; neighbours are at most ``max_tokens`` apart. ``close`` asks
    for a path to the last position; without it the path ends at the cheapest cut within
    one window of the end.
    """
    n = len(position)
    hits, size = [], 1
    while size <= max_tokens:
        at = np.searchsorted(position, position - size)
        to = np.flatnonzero((at < n) & (position[np.minimum(at, n - 1)] == position - size))
        hits.append((to, at[to]))
        size *= 2
    to, source = map(np.concatenate, zip(*hits))
    order = np.argsort(to, kind="stable")
    # pairs of cuts that a power of two lies between, in order of the second
    exact_to, exact_from, seen = [*to[order].tolist(), n], source[order].tolist(), 0
    pos, pen = position.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    # the queue: cuts, their positions and keys (cost plus position), keys rising
    queue, place, key, head = [0], [0], [0.0], 0
    for j in range(1, n):
        p = pos[j]
        least = p - max_tokens
        while place[head] < least:
            head += 1
        i, best = queue[head], key[head] - least
        while exact_to[seen] == j:
            x = exact_from[seen]
            seen += 1
            if cost[x] < best:
                best, i = cost[x], x
        cost[j] = best = best + 1 + pen[j]
        back[j] = i
        best += p
        while len(key) > head and key[-1] >= best:
            del queue[-1], place[-1], key[-1]
        queue.append(j)
        place.append(p)
        key.append(best)
    last = n - 1
    if not close:
        low = int(np.searchsorted(position, position[-1] - max_tokens))
        last = min(range(max(low, 1), n), key=lambda j: (cost[j] + (pos[-1] - pos[j]) * 1e-3, -j))
    path = [last]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


class Packer:
    """One task's line of ids: ``add`` documents, then ``close``; both yield rows of pieces."""

    def __init__(self, enc: RankEncoder, task: int, max_tokens: int, buffer_tokens: int, sentence_penalty: float, inner_penalty: float, end_id: int):
        self.enc, self.task, self.max, self.limit = enc, task, max_tokens, buffer_tokens
        self.penalties, self.end_id, self.made = (sentence_penalty, inner_penalty), end_id, 0
        self.docs: list[tuple] = []  # id, ids still to place, ids before them, all ids
        self.held = 0
        stops = np.array([b[-1:] in (b".", b"!", b"?") for b in enc.token_bytes] + [False])
        opens = np.array([b[:1] in (b" ", b"\n", b"") for b in enc.token_bytes] + [True])
        line = np.array([b[-1:] == b"\n" for b in enc.token_bytes] + [False])
        self.stops, self.opens, self.line = stops, opens, line

    def add(self, doc_id, text) -> list[tuple]:
        got = np.append(self.enc.encode(text), np.array([self.end_id], self.enc.dtype))
        self.docs.append((doc_id, got, 0, len(got)))
        self.held += len(got)
        return self.flush(False) if self.held >= self.limit else []

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the line may be cut, and the penalty there."""
        sentence = np.nonzero((self.stops[ids[:-1]] & self.opens[ids[1:]]) | self.line[ids[:-1]])[0] + 1
        at = np.union1d(np.concatenate(([0], ends)), sentence)
        gaps, step = np.diff(at), max(1, self.max // 16)
        wide = np.nonzero(gaps > step)[0]
        inner = np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in wide] or [np.zeros(0, np.int64)])
        at = np.union1d(at, inner)
        cost = np.full(len(at), self.penalties[0])
        cost[np.isin(at, inner)] = self.penalties[1]
        cost[np.isin(at, ends)] = 0.0
        return at, cost

    def flush(self, close: bool) -> list[tuple]:
        if not self.docs:
            return []
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        at, cost = self.candidates(ids, ends)
        cuts = at[choose_cuts(at, cost, self.max, close)].tolist()
        rows, k, begin = [], 0, 0
        for low, high in zip(cuts, cuts[1:]):
            sequence, x = (self.task << 36) | self.made, low
            self.made += 1
            while x < high:
                doc_id, own, before, total = self.docs[k]
                stop = min(high, begin + len(own))
                piece = own[x - begin : stop - begin]
                rows.append((doc_id, before + x - begin, stop - x, piece.astype("<u4").tobytes(), total, sequence, x - low))
                x = stop
                if stop == begin + len(own):
                    begin += len(own)
                    k += 1
        left = self.docs[k:]
        if left and (done := cuts[-1] - begin) > 0:
            doc_id, own, before, total = left[0]
            left[0] = (doc_id, own[done:], before + done, total)
        self.docs, self.held = left, sum(len(d[1]) for d in left)
        return rows


def pack(
    df: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    buffer_tokens: int = 1 << 17,
    sentence_penalty: float = 8.0,
    inner_penalty: float = 64.0,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: document, ids before it, length, packed ids, the document's ids, sequence and offset there."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(rank_encoder(path), TaskContext.get().partitionId(), max_tokens, buffer_tokens, sentence_penalty, inner_penalty, end_id)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for batch in small_batches(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rows := packer.add(doc_id, text):
                    yield out(rows)
        if rows := packer.flush(True):
            yield out(rows)

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, SCHEMA)
