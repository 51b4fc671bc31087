"""License scans against brute force: every window's cosine, and inheritance up a random tree."""

import math
import random
from collections import Counter

import pytest

from orogen.llm import licenses


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
        ("# spdx-license-identifier: gpl-2.0-only", "GPL-2.0"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("SPDX-License-Identifier: LGPL-2.1+ trailing words", "LGPL-2.1"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
        ("<!-- SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND (MIT OR Zlib) -->", "(GPL-2.0 WITH Linux-syscall-note) AND (MIT OR Zlib)"),
        ("SPDX-License-Identifier: Unheard-Of-9", "Unheard-Of-9"),
        ("SPDX-License-Identifier: MIT AND", "MIT"),
        ("SPDX-License-Identifier: (MIT", None),
        ("SPDX-License-Identifier:", None),
        ("SPDX-License-Identifier: */", None),
        ("the words SPDX and License-Identifier: MIT", None),
    ],
)
def test_tags(line, want):
    got = licenses.spdx(f"first line\n{line}\nnext line AND Apache-2.0")
    assert (got and got[0]) == want
    name, cos, matched, total = licenses.Matcher(10, {}).text(f"some code\n{line}\nmore code", 0.8)
    assert (name, cos) == ((want, 1.0) if want else (None, 0.0)) and 0 <= matched <= total and bool(matched) == bool(want)


@pytest.mark.parametrize("name", sorted({n for n, _ in licenses.NOTICES}))
def test_every_notice_is_found_in_a_wrapped_header(name):
    for n, text in licenses.NOTICES:
        if n == name:
            words, lines = text.split(), []
            while words:
                lines.append(" * " + " ".join(words[:9]))
                words = words[9:]
            got = licenses.Matcher(1000, {}).text("int x;\n/*\n" + "\n".join(lines) + "\n */\nint main", 0.8)
            assert got[0] == name, (text, got)


def naive_windows(m, words, at, threshold):
    size = m.lengths[at]
    out = []
    for i in range(len(words) - size + 1):
        weights = {w: (1 + math.log(c)) * m.idf.get(w, m.unseen) for w, c in Counter(words[i : i + size]).items()}
        dot = sum(x * m.vectors[at][1].get(w, 0.0) for w, x in weights.items())
        cos = round(dot / math.sqrt(sum(x * x for x in weights.values())), 9)
        if cos >= threshold:
            out.append((cos, i, i + size))
    return out


def test_stretches_are_all_windows_over_the_threshold():
    r = random.Random(8)
    m = licenses.Matcher(500, {w: r.randint(0, 400) for w in sorted(licenses.VOCABULARY)})
    short = [k for k, n in enumerate(m.lengths) if n <= 60]
    hits = 0
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 6)):
            part = licenses.words_of(licenses.TEMPLATES[r.choice(short)][1])
            part = [w for w in part if r.random() < 0.95]
            if r.random() < 0.3:
                r.shuffle(part)
            words += part + [r.choice(["filler", "the", "software", "of", "x9"]) for _ in range(r.randint(0, 12))]
        reach = set(m.reachable(set(words), 0.8))
        for at in short:
            want = naive_windows(m, words, at, 0.8)
            assert sorted(m.stretches(words, at, 0.8)) == sorted(want) and (at in reach or not want)
            hits += len(want)
    assert hits > 100


def test_inheritance_up_a_random_tree(spark):
    r = random.Random(3)
    names = ["MIT", "Apache-2.0", "ISC", "BSD-3-Clause"]
    rows = []
    for i in range(250):
        folder = "/".join(r.choice("ab") for _ in range(r.randint(0, 5)))
        kind = r.random()
        leaf = r.choice(["LICENSE", "COPYING.txt"]) if kind < 0.08 else f"f{i}.c"
        text = f"SPDX-License-Identifier: {r.choice(names)}" + (" " + "code " * 40 if kind > 0.04 else "") if kind < 0.14 else "just code and more code"
        rows.append((i, f"{folder}/{leaf}" if folder else leaf, text))
    rows += [(900, None, "code"), (901, None, "SPDX-License-Identifier: MIT"), (902, "a/b/zz.c", None)]
    m, own, grants = licenses.Matcher(1, {}), {}, {}
    for i, path, text in rows:
        name, cos, matched, total = m.text(text, 0.8)
        own[i] = name
        if name and path is not None:
            folder, _, leaf = path.rpartition("/")
            if leaf in ("LICENSE", "COPYING.txt") or matched >= 0.25 * total:
                grants.setdefault(folder, []).append((-cos, path, name))
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    inherited = 0
    for i, path, _ in rows:
        want = own[i], own[i], "own" if own[i] else "none", None
        if not own[i] and path is not None:
            parts = path.split("/")[:-1]
            for k in range(len(parts), -1, -1):
                if "/".join(parts[:k]) in grants:
                    want = None, min(grants["/".join(parts[:k])])[2], "inherited", "/".join(parts[:k])
                    break
        x = got[i]
        assert (x["own_license"], x["license"], x["origin"], x["from_folder"]) == want, (path, want, x)
        inherited += want[2] == "inherited"
    assert inherited > 20
