"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is fixed and public: the pieces of a subword model. Each language has
a probability for every piece. A word's probability in a language is the sum over all ways to
cut it into pieces of the product of their probabilities, which a forward pass over
the word's positions yields; a text's is the product over its words (pieces do not reach over
white space), so each distinct word is summed once per task. The forward pass handles many
words at a time: matches of all words, from one Aho-Corasick scan, are combined position by
position, for at most ``STATES`` positions times languages. A longer word (text without white space) is
summed alone, and only the positions that the longest piece reaches back to are held, so
memory does not grow with the word. Characters that are no piece count as one unknown piece.

Training: piece counts are expectations over all segmentations of the training words
under equal piece probabilities, smoothed by ``smoothing``, on at most ``sample_rows`` labelled
rows (documented bound; the rows whose hashed ids come first). Their ids are few enough to
broadcast; the model has as many rows as languages times pieces. To learn from, words longer than ``LONG`` characters are
cut into words of that length.

Cases: null text, or text without letters: ``und`` with score 0; null languages are not
learned; with nothing to learn from every text is ``und``; ties go to the first language
in order; repeated rows have repeated results; an empty table gives an empty table; other
input columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orogen.llm.bpe import small_batches, vocabulary_path
from orogen.llm.shared import arrow_map, fresh, quoted, worker_table

WORDS_KEPT = 400_000
LONG = 1 << 12
STATES = 1 << 19
SIZE_BITS = 16
QUANTUM = 1 << 16
LETTER = regex.compile(r"\p{L}")
MARKS = ".,;:!?()\"'"  # fixed value: marks that stand as words of their own


class Pieces:
    """The fixed vocabulary, and matches of its pieces in many words at a time."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.auto, self.single, self.longest = ahocorasick.Automaton(), set(), 1
        self.size = model.get_piece_size() + 1  # the last is the unknown piece
        for i in range(self.size - 1):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                piece = model.id_to_piece(i)
                self.auto.add_word(piece, i << SIZE_BITS | len(piece))  # one number: nothing to unpack for each match
                self.longest = max(self.longest, len(piece))
                if len(piece) == 1:
                    self.single.add(piece)
        self.auto.make_automaton()
        self.known = regex.compile("[" + "".join(map(regex.escape, sorted(self.single))) + "\n]+")

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every match, and each word's first position.

        Positions count the borders between characters of all words, a word of n
        characters having n + 1.
        """
        joined = "\n".join("▁" + w for w in words)
        last, found = np.fromiter(chain.from_iterable(self.auto.iter(joined)), np.int64).reshape(-1, 2).T
        piece, size = found >> SIZE_BITS, found & ((1 << SIZE_BITS) - 1)
        lone, at = [], 0
        for run in self.known.finditer(joined):
            lone.extend(range(at, run.start()))
            at = run.end()
        lone = np.array([*lone, *range(at, len(joined))], np.int64)
        first = np.cumsum([0] + [len(w) + 2 for w in words])[:-1]
        start, end = np.concatenate((last + 1 - size, lone)), np.concatenate((last, lone)) + 1
        return start, end, np.concatenate((piece, np.full(len(lone), self.size - 1))), first


def sweep(source: np.ndarray, target: np.ndarray, step: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """``total[target] = logsum(total[source] + weight)`` over all matches, in rising ``step``."""
    order = np.lexsort((target, step))
    source, target, step, weight = source[order], target[order], step[order], weight[order]
    edge = np.flatnonzero(np.diff(step)) + 1
    for low, high in zip([0, *edge.tolist()], [*edge.tolist(), len(step)]):
        if low == high:
            continue
        to = target[low:high]
        group = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1))
        total[to[group]] = np.logaddexp.reduceat(total[source[low:high]] + weight[low:high], group, axis=0)


def forward(pieces: Pieces, words: list[str], logp: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows) in each language; ``logp``: pieces by languages."""
    start, end, piece, first = pieces.matches(words)
    total = np.full((int(first[-1]) + len(words[-1]) + 2 if words else 0, logp.shape[1]), -np.inf)
    total[first] = 0.0
    word = np.searchsorted(first, start, "right") - 1
    sweep(start, end, end - first[word], logp[piece], total)
    return total[first + np.array([len(w) + 1 for w in words], np.int64)]


def forward_long(pieces: Pieces, word: str, logp: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length in each language, over a ring of the positions that a piece can reach back to."""
    text, size = "▁" + word, pieces.longest + 1
    ring = np.full((size, logp.shape[1]), -np.inf)
    ring[0] = 0.0
    found = pieces.auto.iter(text)
    at = next(found, None)
    for end in range(1, len(text) + 1):
        source, piece = [], []
        while at is not None and at[0] == end - 1:
            piece.append(at[1] >> SIZE_BITS)
            source.append((end - (at[1] & ((1 << SIZE_BITS) - 1))) % size)
            at = next(found, None)
        if text[end - 1] not in pieces.single:
            piece.append(pieces.size - 1)
            source.append((end - 1) % size)
        ring[end % size] = np.logaddexp.reduce(ring[source] + logp[piece], axis=0)
    return ring[len(text) % size]


def word_losses(pieces: Pieces, words: list[str], logp: np.ndarray) -> Iterator[np.ndarray]:
    """``forward`` of all words in order, by groups of bounded size."""
    group, held = [], 0
    for word in words:
        if len(word) > LONG:
            if group:
                yield forward(pieces, group, logp)
            yield forward_long(pieces, word, logp)[None, :]
            group, held = [], 0
            continue
        group.append(word)
        held += (len(word) + 2) * logp.shape[1]
        if held > STATES:
            yield forward(pieces, group, logp)
            group, held = [], 0
    if group:
        yield forward(pieces, group, logp)


def expected_counts(pieces: Pieces, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected piece counts by language of words seen ``times`` (rows: words), all pieces alike."""
    start, end, piece, first = pieces.matches(words)
    size = np.array([len(w) + 1 for w in words], np.int64)
    word = np.searchsorted(first, start, "right") - 1
    flat = np.full((len(start), 1), -np.log(pieces.size))
    ahead = np.full((int(first[-1] + size[-1]) + 1, 1), -np.inf)
    behind = ahead.copy()
    ahead[first], behind[first + size] = 0.0, 0.0
    sweep(start, end, end - first[word], flat, ahead)
    sweep(end, start, first[word] + size[word] - start, flat, behind)
    with np.errstate(invalid="ignore"):
        share = np.nan_to_num(np.exp(ahead[start] + flat + behind[end] - ahead[first + size][word]))
    out = np.zeros((pieces.size, times.shape[1]))
    np.add.at(out, piece, share * times[word])
    return out


def words_of(text: str) -> list[str]:
    text = text.lower()
    for mark in MARKS:
        text = text.replace(mark, f" {mark} ")
    return text.split()


def by_length(words: list[str]) -> Iterator[list[str]]:
    """Groups of at most 4,096 words and some 64 * ``LONG`` characters."""
    group, held = [], 0
    for word in words:
        group.append(word)
        held += len(word)
        if len(group) == 4096 or held >= 64 * LONG:
            yield group
            group, held = [], 0
    if group:
        yield group


_loaded: dict[str, Pieces] = worker_table("langid")
_words: dict = worker_table("langid")


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def train(df: DataFrame, path: str, id_col: str, text_col: str, lang_col: str, sample_rows: int, smoothing: float) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of pieces (rows) by language, from labelled rows."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null and doc_id is not null")
    sample = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()
    rows = rows.join(F.broadcast(sample), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen, sums = pieces_of(path), {}, {}

        def settle():
            words, langs = list({w for c in seen.values() for w in c}), list(seen)
            for part in by_length(words):
                got = expected_counts(pieces, part, np.array([[seen[g].get(w, 0) for g in langs] for w in part], float))
                for i, g in enumerate(langs):
                    sums[g] = sums.get(g, 0) + got[:, i]
            seen.clear()

        for batch in small_batches(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if any(len(w) > LONG for w in words):
                    words = [w[i : i + LONG] for w in words for i in range(0, len(w), LONG)]
                seen.setdefault(lang, Counter()).update(words)
            if sum(map(len, seen.values())) > 100_000:
                settle()
        settle()
        for lang, s in sums.items():
            whole = np.rint(s * QUANTUM).astype(np.int64)  # integers: the sum has no order
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(whole[at])], names=["lang", "piece", "n"])

    sums = arrow_map(rows, count, "lang string, piece bigint, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs, size = sorted(set(sums["lang"])), pieces_of(path).size
    counts = np.full((size, len(langs)), float(smoothing))
    for i, g in enumerate(langs):
        mine = sums[sums["lang"] == g]
        counts[mine["piece"].to_numpy(np.int64), i] += mine["n"].to_numpy(float) / QUANTUM
    return langs, np.log(counts / counts.sum(axis=0, keepdims=True)) if langs else np.zeros((size, 0))


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], path: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row: the likeliest language and its tempered posterior.

    With ``carry`` the columns of ``df`` come instead of ``doc_id``, in their order, then ``_lang_pred`` and ``_score``
    (columns of ``df`` with these two names are replaced).
    """
    langs, logp = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        if _words.get("model") is None or not np.array_equal(_words["model"], logp):
            _words.update(model=logp, at={}, table=np.zeros((1024, len(langs))))
        for batch in small_batches(batches, last):
            texts = batch.column(last).to_pylist()
            split = [words_of(t) if t and langs and LETTER.search(t) else [] for t in texts]
            at = _words["at"]
            if len(at) > WORDS_KEPT:
                at.clear()
            new = list({w for words in split for w in words if w not in at})
            base, table = len(at), _words["table"]
            if base + len(new) > len(table):
                _words["table"] = table = np.concatenate((table[:base], np.zeros((base + 2 * len(new), len(langs)))))
            low = base
            for part in word_losses(pieces, new, logp):
                table[low : low + len(part)] = part
                low += len(part)
            at.update(zip(new, range(base, base + len(new))))
            names, scores = [], []
            for words in split:
                if not words:
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(total.argmax())
                names.append(langs[best])
                scores.append(float(1 / np.exp((total - total[best]) / np.sqrt(len(words))).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=plain)

    fields, columns, results = [T.StructField("doc_id", T.LongType())], [F.col(id_col).cast("bigint").alias("doc_id")], ("lang_pred", "score")
    if carry:
        results = ("_lang_pred", "_score")
        fields = [f for f in df.schema.fields if f.name.lower() not in results]
        columns = quoted([f.name for f in fields])
    last = len(fields)
    # mapInArrow can't pass every name (one with a dot): there, columns go by their places
    plain = [f"c{i}" for i in range(last + 2)]
    rows = df.select(*columns, F.col(text_col).cast("string").alias(fresh(df, "_text")[0])).toDF(*plain[: last + 1])
    kinds = [*[f.dataType for f in fields], T.StringType(), T.DoubleType()]
    done = arrow_map(rows, run, T.StructType([T.StructField(n, t) for n, t in zip(plain, kinds)]))
    return done.toDF(*[f.name for f in fields], *results)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: a fixed quarter by checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000, smoothing: float = 0.05, carry: bool = False) -> DataFrame:
    """Learn from the rows outside the held-out quarter and predict all: ``doc_id, lang_pred, score``."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    model = train(df.where(~held_out(id_col)), path, id_col, text_col, lang_col, sample_rows, smoothing)
    return predict(df, model, path, id_col, text_col, carry)
