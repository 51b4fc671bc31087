"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn. The
markers are special tokens, so no token reaches over a border of a turn. In roles and
texts every ``<``, any backslashes and ``|`` get one more backslash after the ``<``: no
marker, and no other control string of that form, can occur inside a text, and taking one
backslash away restores it.

Each rendered part is encoded once, with offsets (the encoder of ``packing.py``, the markers as special tokens). The sorted character spans of assistant
texts are intersected with the token spans by binary search, which gives the mask over
tokens.

Rows are dealt out by conversation and by stretch of turns, so that a conversation that
holds a large share of all rows is rendered and encoded by many tasks; as the markers are
cut out before anything else is encoded, the parts' ids in order are the conversation's.
Only the final digests, which are sequential by definition, go over a conversation's
parts in order, one at a time.

Cases: null role, null text: empty; turns in the order (turn, role, text), nulls first;
ties and repeated rows are all kept; rows of null ``conv_id`` form one conversation; no
rows: no conversations; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.bpe import vocabulary_path
from orogen.llm.packing import rank_encoder
from orogen.llm.shared import arrow_map

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END), re.S)
PART_SCHEMA = "conv_id bigint, part bigint, sub bigint, n_turns bigint, formatted string, ids binary, mask binary, loss_start array<bigint>, loss_end array<bigint>"
DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, loss_tokens bigint, n_tokens bigint"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of its non-empty assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        at += len(head)
        if role == "assistant" and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        out += [head, body, END]
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (rows of start and end, sorted) meet one of the sorted spans."""
    mask = np.zeros(len(offsets), bool)
    if spans and len(offsets):
        s = np.array(spans)
        first = np.searchsorted(offsets[:, 1], s[:, 0], "right")
        last = np.searchsorted(offsets[:, 0], s[:, 1], "left")
        for a, b in zip(first.tolist(), last.tolist()):
            mask[a:b] = True
    return mask


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> tuple[list[int], list[int]]:
    """Character spans of the runs of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return offsets[edge[0::2], 0].tolist() if len(edge) else [], offsets[edge[1::2] - 1, 1].tolist() if len(edge) else []


def format_chats(df: DataFrame, path: str | None = None, part_turns: int = 256) -> DataFrame:
    """Rendered, encoded and masked parts of every conversation (``conv_id, turn, role, text`` in)."""
    path = path or vocabulary_path()
    part = F.coalesce(F.floor(F.col("turn") / part_turns).cast("bigint"), F.lit(-(1 << 62)))
    rows = df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("part", part)
    rows = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text").select("conv_id", "part", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(path, (START, SEP, END))
        waiting: list[tuple] = []
        size, key, turns, sub, chars = 0, None, [], 0, 0

        def emit():
            out = []
            for conv, part, sub, turns in waiting:
                text, spans = render(turns)
                ids, offsets = enc.encode_offsets(text)
                mask = token_mask(offsets, spans)
                a, b = masked_spans(offsets, mask)
                out.append((conv, part, sub, len(turns), text, ids.astype("<u4").tobytes(), np.packbits(mask).tobytes(), a, b))
            waiting.clear()
            types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["conv_id", "part", "sub", "n_turns", "formatted", "ids", "mask", "loss_start", "loss_end"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)

        for batch in batches:
            for conv, part, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if turns and ((conv, part) != key or len(turns) >= part_turns or chars > 1 << 20):
                    waiting.append((*key, sub, turns))
                    size += chars
                    sub = sub + 1 if (conv, part) == key else 0
                    turns, chars = [], 0
                    if size > 1 << 20:
                        size = 0
                        yield emit()
                key = (conv, part)
                turns.append((role, text))
                chars += len(text)
        if turns:
            waiting.append((*key, sub, turns))
        if waiting:
            yield emit()

    return arrow_map(rows, run, PART_SCHEMA)


def digests(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the parts' texts, tokens and masks."""
    rows = parts.select("conv_id", "part", "sub", "formatted", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "mask", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def done():
            turns, turn_hash, chars, loss_hash, size, masked, tokens = state
            out.append((key[0], turns, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), size, masked, tokens))

        def batch_of():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")])
            out.clear()
            return got

        for batch in batches:
            for conv, formatted, tokens, mask, begin, end in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7))):
                if key != (conv,):
                    if key:
                        done()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, b in zip(begin, end):
                    text = unescape(formatted[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] += int(np.unpackbits(np.frombuffer(mask, np.uint8)).sum())
                state[6] += tokens
            if len(out) >= 4096:
                yield batch_of()
        if key:
            done()
        if out:
            yield batch_of()

    return arrow_map(rows, run, DIGEST_SCHEMA)
