"""Licence scans: TF-IDF cosine of text to licence templates, then inheritance down the directories.

Templates are short notices and whole licence texts. A text is one sequence of words whatever its line
breaks; every line, the whole text, and every stretch as long as a template is a sparse vector over the words of
the templates (inverse document frequencies are counted over all texts; a word of no template weighs as one that no
text holds) and is compared with that template by cosine. A stretch is passed over only where its words cannot
reach the threshold. A file's own licence is the best match at or over ``threshold``; ties go to the first identifier in order;
a notice inside a matched stretch of a template at least twice as long (a licence text that quotes it) does not count for that.
An SPDX tag (``SPDX-License-Identifier:`` and an expression of identifiers with AND, OR, WITH and brackets) is a declaration, not a likeness:
the first one in a text is its licence with similarity 1. Identifiers lose ``-only``, ``-or-later`` and ``+``; unknown ones stay as they are written.

A file is a licence file if its name says so or if the words of all matched stretches together are at least ``file_share`` of its
words; the best licence file of a directory (highest cosine, then lowest path) gives that directory its licence.

A file without a licence of its own inherits from its nearest ancestor directory that has one. Only distinct
directories are replicated to their ancestors, and each directory's answer is found once by
joins on paths before files look it up, so a directory that holds a third of all files is one row there.

Cases: null text: no licence of its own; null path: nothing is inherited; repeated rows have repeated
results; an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.bpe import small_batches
from orogen.llm.license_texts import TEXTS
from orogen.llm.shared import arrow_map, materialise

# Short notices as files carry them, by SPDX identifier.
NOTICES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
TEMPLATES = NOTICES + TEXTS
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}.\-]*")


TAG = regex.compile(r"SPDX-License-Identifier:[ \t]*(\S[^\r\n]*)", regex.IGNORECASE)
TOKEN = regex.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.\-]*\+?)")
NAMES = {name.lower(): name for name, _ in TEMPLATES}


def spdx(text: str) -> tuple[str, int] | None:
    """The first tag's expression, identifiers in their plain form, and the tag's words."""
    for tag in TAG.finditer(text):
        # tokens as far as they can stand in an expression; it ends where an operand did and no bracket is open
        parts, whole, at, open_, operand = [], 0, 0, 0, True
        while token := TOKEN.match(tag[1], at):
            t = token[1]
            if operand and t == "(":
                open_ += 1
            elif operand and t not in ("AND", "OR", "WITH", ")"):
                plain = regex.sub(r"(-only|-or-later|\+)$", "", t)
                t, operand = NAMES.get(plain.lower(), plain), False
            elif not operand and t == ")" and open_:
                open_ -= 1
            elif not operand and t in ("AND", "OR", "WITH"):
                operand = True
            else:
                break
            parts.append(t)
            at = token.end()
            if not operand and not open_:
                whole, end = len(parts), at
        if whole:
            return " ".join(parts[:whole]).replace("( ", "(").replace(" )", ")"), len(words_of(tag[0][: tag.start(1) - tag.start() + end]))
    return None


def words_of(text: str) -> list[str]:
    return [w.rstrip(".-") for w in WORD.findall(text.lower())]


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in words_of(t))


def document_frequencies(rows: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those that hold each word of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for batch in small_batches(batches, 0):
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    seen.update(VOCABULARY.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.string()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    sums = arrow_map(rows.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in sums}
    return found.pop(None, 0), found


class Matcher:
    """Cosines of a text's stretches to the templates."""

    def __init__(self, n: int, frequency: dict[str, int]):
        self.idf = {w: math.log((1 + n) / (1 + frequency.get(w, 0))) + 1 for w in VOCABULARY}
        self.unseen = math.log(1 + n) + 1
        self.vectors, self.lengths = [], []
        self.shares = defaultdict(list)
        for at, (name, text) in enumerate(TEMPLATES):
            words = words_of(text)
            v = {w: (1 + math.log(c)) * self.idf[w] for w, c in Counter(words).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append((name, {w: x / norm for w, x in v.items()}))
            self.lengths.append(len(words))
            for w, x in self.vectors[-1][1].items():
                self.shares[w].append((at, x * x))

    def reachable(self, words: set[str], threshold: float) -> list[int]:
        """Templates that a stretch of these words can reach: by Cauchy-Schwarz a cosine is at most the length of the template's part over shared words."""
        mass: dict[int, float] = defaultdict(float)
        for w in words & VOCABULARY:
            for at, share in self.shares[w]:
                mass[at] += share
        return [at for at, m in mass.items() if m >= (threshold - 1e-9) ** 2]

    def needed(self, at: int, threshold: float) -> set[str]:
        """Words of which a stretch must hold one to reach the threshold."""
        rest, out = 1.0, set()
        for w, x in sorted(self.vectors[at][1].items(), key=lambda p: (-p[1], p[0])):
            if rest < (threshold - 1e-9) ** 2:
                break
            out.add(w)
            rest -= x * x
        return out

    def cosine(self, words: list[str], at: int) -> float:
        weights = {w: (1 + math.log(c)) * self.idf.get(w, self.unseen) for w, c in Counter(words).items()}
        vector = self.vectors[at][1]
        return round(sum(x * vector.get(w, 0.0) for w, x in weights.items()) / math.sqrt(sum(x * x for x in weights.values())), 9)

    def stretches(self, words: list[str], at: int, threshold: float) -> list[tuple[float, int, int]]:
        """Cosine, start and end of all stretches of the template's length that reach the threshold."""
        size, vector, needed = self.lengths[at], self.vectors[at][1], self.needed(at, threshold)
        ranges: list[list[int]] = []  # of starts
        for i, w in enumerate(words):
            if w in needed:
                low, high = max(0, i - size + 1), min(i, len(words) - size)
                if ranges and low <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(high, ranges[-1][1])
                elif low <= high:
                    ranges.append([low, high])
        out, logs = [], [0.0, *(1 + math.log(c) for c in range(1, size + 2))]
        for low, high in ranges:
            count, dot, norm = Counter(words[low : low + size]), 0.0, 0.0
            for w, c in count.items():
                x = logs[c] * self.idf.get(w, self.unseen)
                dot, norm = dot + x * vector.get(w, 0.0), norm + x * x
            for i in range(low, high + 1):
                if i > low:
                    for w, step in ((words[i - 1], -1), (words[i + size - 1], 1)):
                        c, f = count[w], self.idf.get(w, self.unseen)
                        dot += (logs[c + step] - logs[c]) * f * vector.get(w, 0.0)
                        norm += (logs[c + step] ** 2 - logs[c] ** 2) * f * f
                        count[w] = c + step
                if dot >= (threshold - 1e-6) * math.sqrt(norm):  # running sums: decided anew without rounding
                    cos = self.cosine(words[i : i + size], at)
                    if cos >= threshold:
                        out.append((cos, i, i + size))
        return out

    def text(self, text: str | None, threshold: float) -> tuple[str | None, float, int, int]:
        """Licence, cosine, matched words and all words of a text."""
        words, tag = words_of(text or ""), spdx(text or "")
        reach = self.reachable(set(words), threshold)
        if not reach:
            return (tag[0], 1.0, tag[1], len(words)) if tag else (None, 0.0, 0, len(words))
        lines, start = {(0, len(words))}, 0
        for line in (text or "").split("\n"):
            end = start + len(words_of(line))
            if end > start:
                lines.add((start, end))
            start = end
        within = {part: set(self.reachable(set(words[part[0] : part[1]]), threshold)) for part in lines}
        covered, matches = bytearray(len(words)), []
        for at in sorted(reach):
            found = [(self.cosine(words[a:b], at), a, b) for (a, b), can in within.items() if at in can]
            found = [x for x in found if x[0] >= threshold] + self.stretches(words, at, threshold)
            used = bytearray(len(words))
            for cos, a, b in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                if not any(used[a:b]):  # of stretches that overlap, the best one counts
                    used[a:b] = covered[a:b] = b"\1" * (b - a)
                    matches.append((-cos, self.vectors[at][0], a, b, self.lengths[at]))
        whole = [m for m in matches if not any(x[4] >= 2 * m[4] and x[2] <= m[2] and m[3] <= x[3] for x in matches)]
        best, name = min((m[:2] for m in whole), default=(0.0, None))
        if tag:
            return tag[0], 1.0, max(tag[1], sum(covered)), len(words)
        return name, -best, sum(covered), len(words)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, threshold: float = 0.8, file_share: float = 0.25) -> DataFrame:
    """``doc_id, path, own_license, similarity, license, origin`` of every row; ``origin``: own, inherited or none."""
    path = F.col("path") if path is None else path
    files = df.select(F.col(id_col).cast("bigint").alias("doc_id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    n, frequency = document_frequencies(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(n, frequency)
        for batch in small_batches(batches, 2):
            found = [matcher.text(t, threshold) for t in batch.column(2).to_pylist()]
            name, cos, matched, total = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(cos, pa.float64()), pa.array(matched, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "path", "own_license", "similarity", "matched", "total"])

    own = arrow_map(files, run, "doc_id bigint, path string, own_license string, similarity double, matched bigint, total bigint")
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    own = materialise(own.withColumn("folder", F.when(F.col("path").isNotNull(), folder)), "licenses")
    named = F.regexp_replace("path", "^.*/", "").rlike(FILE_NAMES)
    grants = own.where(F.col("own_license").isNotNull() & F.col("folder").isNotNull() & (named | (F.col("matched") >= file_share * F.col("total"))))
    grants = grants.groupBy("folder").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "own_license")).alias("g"))
    grants = grants.select(F.col("folder").alias("ancestor"), F.col("g.own_license").alias("granted"))
    folders = own.where("folder is not null").select("folder").distinct()
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("ancestor")))
    above = folders.select("folder", F.inline(above))
    nearest = above.join(grants, "ancestor").groupBy("folder").agg(F.max_by("granted", "depth").alias("granted"), F.max_by("ancestor", "depth").alias("from_folder"))
    out = own.join(nearest, "folder", "left")
    licence = F.coalesce("own_license", "granted")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", "own_license", "similarity", licence.alias("license"), origin.alias("origin"), F.when(origin == "inherited", F.col("from_folder")).alias("from_folder"))
