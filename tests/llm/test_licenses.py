"""The licence scan against a plain version, and known headers."""

import math
import re
from collections import Counter

import pytest

from framesieve.llm import licenses as L

WORD = re.compile("[a-z0-9]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain_terms(words):
    return [*words, *(f"{a}~{b}" for a, b in zip(words, words[1:], strict=False) if b.isdigit())]


def plain_segments(text, whole):
    words = plain_words(text)
    out = [plain_words(x) for x in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text)]]
    for n in L.WINDOWS:
        out += [words[k : k + n] for k in range(0, max(1, len(words) - n + n // 4), n // 4)]
    return [s for s in [*out, *[words] * whole] if set(s) & set(L.ANCHORS)]


def plain_own(rows):
    """(score, licence) or None of each (text, whole)."""
    spdx = {x.lower(): x for x in L.SPDX}
    found, open_rows = {}, []
    for k, (text, whole) in enumerate(rows):
        m = re.search(L.SPDX_LINE, text or "")
        name = spdx.get(re.sub("(?:-only|-or-later|[+])$", "", m[1].rstrip(".")).lower()) if m else None
        if name:
            found[k] = (1.0, name)
        elif set(plain_words(text or "")) & set(L.ANCHORS):
            open_rows.append(k)
    templates = [(name, Counter(L.terms(t))) for name, t in L.TEMPLATES]
    n = len(open_rows) + len(templates)
    df = Counter(t for _, c in templates for t in c)
    seen = Counter(t for k in open_rows for t in set(plain_terms(plain_words(rows[k][0]))))
    idf = {t: math.log((1 + n) / (1 + d + seen[t])) + 1 for t, d in df.items()}
    other = math.log(1 + n) + 1
    vectors = []
    for name, c in templates:
        length = math.sqrt(sum((x * idf[t]) ** 2 for t, x in c.items()))
        vectors.append((name, {t: x * idf[t] / length for t, x in c.items()}))
    for k in open_rows:
        best = (False, 0.0, False, "")
        for s in plain_segments(*rows[k]):
            v = {t: x * idf.get(t, other) for t, x in Counter(plain_terms(s)).items()}
            length = math.sqrt(sum(x * x for x in v.values()))
            scores = {}
            for name, w in vectors:
                scores[name] = max(scores.get(name, 0.0), math.floor(sum(x * w.get(t, 0.0) for t, x in v.items()) / length * 1e6 + 0.5) / 1e6)
            first, second = sorted(((x, name) for name, x in scores.items()), reverse=True)[:2]
            if first[0] >= L.THRESHOLD:
                known = first[0] - second[0] >= L.MARGIN
                best = max(best, (known and first[1] in L.WIDER and first[0] >= L.WIDER_FROM, first[0], known, first[1] if known else ""))
        found[k] = (best[1], best[3]) if best[2] else None
    return [found.get(k) for k in range(len(rows))]


GPL2 = "/* This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version. */\nint main;"
HEADERS = {
    "GPL-2.0": ["// SPDX-License-Identifier: GPL-2.0", "x SPDX-License-Identifier: GPL-2.0-only.", GPL2], "GPL-3.0": ["# SPDX-License-Identifier: GPL-3.0+", GPL2.replace("version 2", "version 3")],
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0-or-later", GPL2.replace("General", "Affero General").replace("version 2", "version 3")], "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-or-later", GPL2.replace("General", "Lesser General").replace("version 2", "version 2.1")],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Copyright 2020 Ann\n\n" + L._BSD], "BSD-3-Clause": ["Copyright 2020 Ann\n\n" + L._BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "EPL-2.0": ["SPDX-License-Identifier: (EPL-2.0 OR GPL-2.0)"], "MIT": ["parser.c - small expression parser for calculators. Released under the MIT License.", "word " * 2_000 + "\nReleased!! under$$$ the*** MIT&&& License###\n" + "tail " * 2_000], "Apache-2.0": ["# Licensed under the Apache License, Version 2.0.\nx = 1"],
}
NOTHING = [None, "", "the and of a", "All rights reserved to the mayor of the town, said the clerk, and all were glad of it", "Licensed to the bank under an apache roof", "SPDX-License-Identifier: Nonsense-9.9", "mit der und ohne", "license"]


def test_headers_and_plain_version(spark):
    rows = [(t, name) for name, texts in HEADERS.items() for t in texts] + [(t, None) for t in NOTHING]
    files = spark.createDataFrame([(k, f"d{k}/a.c", t, "x") for k, (t, _) in enumerate(rows)], "`doc.id` long, path string, text string, row string")
    got = {r[0]: (r["score"], r["licence"]) for r in L.scan(files, key="doc.id").collect()}
    for k, want in enumerate(plain_own([(t, False) for t, _ in rows])):
        assert got[k] == (want or (None, None)), rows[k]
    assert [got[k][1] for k in range(len(rows))] == [name for _, name in rows]


def test_every_template_has_an_anchor_and_names_its_licence():
    assert all(set(plain_words(t)) & set(L.ANCHORS) for _, t in L.TEMPLATES) and len({n for n, _ in L.TEMPLATES}) >= 40
    own = plain_own([(t, True) for _, t in L.TEMPLATES])
    assert [o and o[1] for o in own] == [n for n, _ in L.TEMPLATES]


FILES = [
    (1, "src/LICENSE", "Released under the MIT License."), (2, "src/a/one.py", "print(1)"), (4, "src/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (5, "src/a/b/c/three.py", "some words"),
    (6, "other/four.py", "the and of a"), (8, None, None), (9, "src/a/one.py", ""), (10, "src/a/b/LICENSE-old", "Released under the MIT License, as is known."), (2, "src/a/one.py", "print(1)"), (11, "srcs/x.py", ""),
]


@pytest.mark.parametrize("root", [False, True])
def test_inheritance(spark, root, monkeypatch):
    rows = FILES + [(12, "LICENSE", "SPDX-License-Identifier: ISC")] * root
    if root:
        monkeypatch.setattr("framesieve.llm.common.BROADCAST_ROWS", 0)
    got = [tuple(r) for r in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).select("doc_id", "licence", "origin", "directory").collect()]
    top = ("ISC", "inherited", "") if root else (None, None, None)
    want = [(1, "MIT", "own", None), (2, "MIT", "inherited", "src"), (2, "MIT", "inherited", "src"), (9, "MIT", "inherited", "src"), (4, "GPL-3.0", "own", None), (5, "GPL-3.0", "inherited", "src/a/b"), (10, "MIT", "own", None), (6, *top), (8, *top), (11, *top)] + [(12, "ISC", "own", None)] * root
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_no_rows(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0
