"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece exactly one token can come last in its encoding. The encoder
walks an Aho-Corasick automaton over the vocabulary, which lists the tokens that are
suffixes of each prefix, longest first, and stores the first one that is compatible with
the stored last token of the prefix it leaves. Following these back-pointers from the
end of the piece emits the exact ids, in time linear in the piece for any length.

Two adjacent tokens are compatible when no merge across their border would have fired
while both of its parts existed. A part on the border exists until the merge that
consumes it, so the test compares the rank of each crossing merge with the ranks at
which the right spine of the left token and the left spine of the right token go.

Texts are cut at spaces and line breaks where the vocabulary's split pattern always has a
border; distinct chunks are encoded once per worker (a bounded table of results).

Cases: null text counts as empty and gives no ids; the vocabulary's special token inside a
text gives its own id, as the library does; repeated rows give repeated results; an
empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.shared import arrow_map, worker_table

# Fixed value: the public split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """Printable stand-in of every byte, as byte-level vocabularies write them."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> tuple[dict[str, int], dict[int, bytes], list[tuple[bytes, bytes]]]:
    """Special tokens, the bytes of all other ids, and the merges of a byte-level vocabulary file."""
    spec = json.loads(open(path, encoding="utf-8").read())
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    to_byte, others = byte_characters(), set(special.values())
    raw = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in others}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return special, raw, [tuple(bytes(to_byte[c] for c in s) for s in pair) for pair in pairs]


class ChunkedEncoder:
    """Cuts texts at borders that every split has and keeps the ids of distinct chunks."""

    def __init__(self, special: dict[str, int], raw: dict[int, bytes], markers: tuple[str, ...] = ()):
        """``raw`` has the bytes of all ids that aren't special; ``markers`` are special tokens that follow the last id."""
        after = 1 + max([*raw, *special.values()])
        self.special, self.size = {**special, **{s: after + i for i, s in enumerate(markers)}}, after + len(markers)
        self.dtype, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.widths = np.zeros(self.size, np.int64)
        for i, b in [*raw.items(), *((i, s.encode()) for s, i in self.special.items())]:
            self.widths[i] = len(b)
        special = self.special
        self.space = regex.compile(r"\s").search
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.chunks = Chunks(self._chunk)

    def whole_text(self, text: str) -> bytes:
        """Packed ids of a text, by the vocabulary's own split."""
        raise NotImplementedError

    def simple_piece(self, piece: str) -> bytes:
        """Packed ids of one piece of the split."""
        raise NotImplementedError

    def _chunk(self, chunk: str) -> bytes | None:
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return self.simple_piece(chunk)
        if body == "" or body != "\n" and self.space(body):
            return None  # white space may meet that of a neighbour: the whole text is split
        return self.whole_text(chunk)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if "\0" not in text:
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            try:
                return b"".join(map(self.chunks.__getitem__, chunks))
            except TypeError:
                pass
        return self.whole_text(text)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.special_split is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), self.dtype)
        out = [
            np.array([self.special[p]], self.dtype).tobytes() if p in self.special else self._plain(p)
            for p in self.special_split.split(text)
        ]
        return np.frombuffer(b"".join(out), self.dtype)

    def encode_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text and the start and end of each in its characters; ids that share a character both cover it."""
        ids = self.encode(text)
        width = self.widths[ids]
        end = np.cumsum(width)
        offsets = np.stack((end - width, end), axis=1)
        if not text.isascii():
            at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
            offsets = np.stack((at[offsets[:, 0]] - 1, at[end - 1]), axis=1)
        return ids, offsets


class PrefixEncoder(ChunkedEncoder):
    """Exact encoder for one byte-level vocabulary file, or for its first ``limit`` ids.

    Ids count up in the order of the merges, so the first ones are a vocabulary as well.
    """

    def __init__(self, path: str, limit: int | None = None):
        import ahocorasick

        special, raw, merges = read_vocabulary(path)
        limit = limit or 1 << 30
        special, raw = {s: i for s, i in special.items() if i < limit}, {i: b for i, b in raw.items() if i < limit}
        super().__init__(special, raw)
        self.token_bytes = [raw.get(i, b"") for i in range(self.size)]
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        ids = {b: i for i, b in raw.items()}
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (left, right) in enumerate(merges):
            x, y = ids.get(left), ids.get(right)
            if x is None or y is None or self.token_bytes[x] + self.token_bytes[y] not in ids:
                continue
            self.rank.setdefault(x << 20 | y, r)
            parts.setdefault(ids[self.token_bytes[x] + self.token_bytes[y]], (x, y, r))
        self.parts = parts
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[int, bool] = {}
        self.whole = {b.decode("latin-1"): i for b, i in ids.items()}
        self.auto = ahocorasick.Automaton()
        for s, i in self.whole.items():
            self.auto.add_word(s, (i, len(s)))
        self.auto.make_automaton()
        self.split = regex.compile(PATTERN)
        self.pieces = Chunks(self._piece)
        self.sizes = self.widths.tolist()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of ``token`` as it is undone, each with the rank that consumes it."""
        if (out := self.edges[side].get(token)) is None:
            out, part = [(token, 1 << 60)], token
            while part in self.parts:
                x, y, until = self.parts[part]
                part = y if side else x
                out.append((part, until))
            self.edges[side][token] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and then ``b`` is the encoding of their bytes."""
        key = a << 20 | b
        if (got := self.known.get(key)) is None:
            right, rank, got = self._edge(b, 0), self.rank, True
            for x, gone_x in self._edge(a, 1):
                for y, gone_y in right:
                    key_xy = x << 20 | y
                    if key_xy in rank and rank[key_xy] < gone_x and rank[key_xy] <= gone_y:
                        got = False
                        break
                if not got:
                    break
            if len(self.known) > 4 * CACHE_ENTRIES:
                self.known.clear()
            self.known[key] = got
        return got

    def last_tokens(self, piece: str) -> list[int]:
        """The last token of every prefix of a piece whose bytes are written as Latin-1."""
        last = [-1] * len(piece)
        known, compatible = self.known.get, self.compatible
        for end, (token, size) in self.auto.iter(piece):
            if last[end] < 0:
                if size <= end:
                    before = last[end - size]
                    ok = known(before << 20 | token)
                    if not (compatible(before, token) if ok is None else ok):
                        continue
                last[end] = token
        return last

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode().decode("latin-1")
        last, at, out = self.last_tokens(raw), len(raw) - 1, []
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= self.sizes[token]
        out.reverse()
        return array(self.code, out).tobytes()

    def simple_piece(self, piece: str) -> bytes:
        return self._piece(piece)

    def whole_text(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split.findall(text)])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Chunks(dict):
    """Results by chunk, CACHE_ENTRIES at most; emptied after as many misses times 16. Long chunks aren't kept."""

    def __init__(self, make):
        self.make, self.missed = make, 0

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) < CACHE_ENTRIES:
                self[key] = value
            else:
                self.missed += 1
                if self.missed >= 16 * CACHE_ENTRIES:
                    self.clear()
                    self.missed = 0
        return value


_loaded: dict[tuple, PrefixEncoder] = worker_table("bpe", "lm")


def encoder(path: str, limit: int | None = None) -> PrefixEncoder:
    """The worker's encoder for a vocabulary file."""
    if (path, limit) not in _loaded:
        _loaded[path, limit] = PrefixEncoder(path, limit)
    return _loaded[path, limit]


def small_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of one string column (one row at least)."""
    for batch in batches:
        n, start = batch.num_rows, 0
        while start < n:
            step = max(1, min(n - start, int((n - start) * limit / max(1, batch.slice(start).column(column).nbytes))))
            yield batch.slice(start, step)
            start += step


def _roundtrip(path: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small_batches(batches, 1):
            ids, sizes, texts = [], [], []
            for text in batch.column(1).to_pylist():
                got = enc.encode(text)
                sizes.append(len(got))
                ids.append(got.astype("<u4").tobytes())
                if with_text:
                    texts.append(enc.decode(got))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every row."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, _roundtrip(path, False), "doc_id bigint, n_tokens bigint, ids binary")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` text of every row of packed ids (null ids: empty text)."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
    return arrow_map(rows, run, "doc_id bigint, decoded string")


def roundtrip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and the text decoded from it, in one narrow pass: no shuffle."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, _roundtrip(path, True), "doc_id bigint, n_tokens bigint, ids binary, decoded string")
