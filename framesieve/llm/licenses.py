"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

A text that holds an SPDX line has that licence. Of other texts, those that hold one of the anchors are cut into segments: lines,
paragraphs, and windows of words of several sizes, a quarter of their size apart, so that a wrapped header or a notice within a line is met by a
window not much longer than itself. Segments are compared with templates by exploded terms, joined to the templates' weights and
summed. A number counts together with the word before it, so that versions tell licences apart. Inverse frequencies come from the
texts that hold anchors and from the templates. Files without a licence get that of the nearest directory above that has a licence file.
Only DataFrame functions run here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, maybe_broadcast, stored

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: How licences are named in headers, and the sentences that tell their texts apart.
TEMPLATES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "Licensed under the ISC License."), ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", _BSD), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-4-Clause", _BSD + " All advertising materials mentioning features or use of this software must display the following acknowledgement. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."), ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"), ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0 (the License)."), ("EUPL-1.2", "Licensed under the European Union Public Licence, EUPL, Version 1.2."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("Zlib", "Licensed under the zlib License."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."), ("PostgreSQL", "Licensed under the PostgreSQL License."), ("NCSA", "Licensed under the University of Illinois NCSA Open Source License."), ("Python-2.0", "Licensed under the Python Software Foundation License Version 2."),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"), ("OSL-3.0", "Licensed under the Open Software License version 3.0"), ("MS-PL", "This license is the Microsoft Public License (Ms-PL)."), ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ODbL-1.0", "This database is made available under the Open Database License, ODbL v1.0."), ("WTFPL", "Do What The Fuck You Want To Public License, Version 2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "Copyright. All rights reserved."), ("Proprietary", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
]
#: What stands after SPDX-License-Identifier, without -only, -or-later and +.
SPDX = sorted({name for name, _ in TEMPLATES if name != "Proprietary"} | {"Apache-1.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CECILL-2.1", "EUPL-1.1", "GFDL-1.2", "GPL-1.0", "LGPL-2.0", "LPPL-1.3c", "MIT-0", "MS-RL", "RPL-1.5", "UPL-1.0", "X11", "AGPL-1.0", "BSD-1-Clause", "Artistic-1.0", "CDDL-1.1", "OFL-1.0", "PSF-2.0"})
SPDX_LINE = r"SPDX-License-Identifier:[ \t]*\(?[ \t]*([A-Za-z0-9.+-]+)"
#: Words of which every template has one at least, and a text that is looked at closer.
ANCHORS = ("cc0", "copyright", "licence", "license", "licensed", "permission", "proprietary", "redistribution", "redistributions", "unencumbered", "warranty")
NEAR = r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"
#: Least cosine, and by how much the best has to be ahead of the next licence, or both are unknown.
THRESHOLD, MARGIN = 0.7, 0.005
#: Licences whose text includes another's: from this score on they come before it, however well a part fits the other.
WIDER, WIDER_FROM = ("BSD-3-Clause", "BSD-4-Clause", "ISC"), 0.9
#: Words of the windows.
WINDOWS = (6, 8, 16, 32, 64, 128)
#: Names of licence files.
LICENCE_FILE = r"(?i)^(?:un)?(?:licen[cs]e|copying|notice)(?:[.-].*)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str) -> list[str]:
    """Words, and numbers with the word before them."""
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return words + [f"{a}~{b}" for a, b in zip(words, words[1:], strict=False) if b.isdigit()]


def template_rows() -> list[tuple[int, str, str, int]]:
    """(template, licence, term, count)."""
    return [(k, name, t, terms(text).count(t)) for k, (name, text) in enumerate(TEMPLATES) for t in sorted(set(terms(text)))]



def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def spdx_of(text: Column) -> Column:
    """The licence of the first SPDX line, null where there's none or it isn't known."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, SPDX_LINE, 1), "[.]+$", ""), "(?:-only|-or-later|[+])$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for known in SPDX for x in (known.lower(), known)]), F.lower(name))


def segments(text: Column, whole: Column) -> Column:
    """Word lists, with an anchor in each: lines, paragraphs, windows and, where ``whole`` holds, all words."""
    lines = F.transform(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n")), lambda x: F.when(x.rlike(NEAR), words_of(x)))

    def windows(words: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + n // 4), F.lit(max(1, n // 4))), lambda k: F.slice(words, k, F.lit(n)))

        return F.concat(*map(of, WINDOWS), F.when(whole, F.array(words)).otherwise(F.array().cast("array<array<string>>")))

    anchors = F.array(*[F.lit(a) for a in ANCHORS])
    cut = F.filter(F.element_at(F.transform(F.array(words_of(text)), windows), 1), lambda w: F.arrays_overlap(w, anchors))
    return F.concat(F.filter(lines, lambda w: w.isNotNull() & F.arrays_overlap(w, anchors)), cut)


def terms_of(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(words))), lambda k: F.when(F.try_element_at(words, k).rlike("^[0-9]+$"), F.concat(F.element_at(words, (k - 1).cast("int")), F.lit("~"), F.element_at(words, k))))
    return F.concat(words, F.array_compact(pairs))


def best_licences(candidates: DataFrame) -> DataFrame:
    """(row, score, licence) of the rows (row, text, whole) that reach the threshold; scores to six places.

    The best template of the best segment counts. If the next licence is less than MARGIN behind in that segment, the text names neither
    for sure and has none.
    """
    spark = candidates.sparkSession
    cut = stored(candidates.select("row", F.explode(segments(F.col("text"), F.col("whole"))).alias("words")), "licences-segments")
    # Copies of a text, and lines that many texts share, are compared once.
    seg = F.xxhash64("words"), F.xxhash64(F.lit(1), F.col("words"))
    own = cut.select(seg[0].alias("s"), seg[1].alias("t"), "words").dropDuplicates(["s", "t"])
    tf = stored(own.select("s", "t", F.explode(terms_of(F.col("words"))).alias("term")).groupBy("s", "t", "term").agg(F.count(F.lit(1)).cast("double").alias("n")), "licences-terms")
    templates = spark.createDataFrame(template_rows(), "k int, licence string, term string, c int")
    vocabulary = templates.groupBy("term").agg(F.count(F.lit(1)).alias("d0"))
    texts = stored(candidates.select("row", words_of(F.col("text")).alias("words")), "licences-words").select("row", F.explode(F.array_distinct(terms_of(F.col("words")))).alias("term"))
    seen = texts.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("d1"))
    n = candidates.count() + len(TEMPLATES)
    idf = vocabulary.join(seen, "term", "left").select("term", (F.log((1.0 + n) / (1.0 + F.col("d0") + F.coalesce("d1", F.lit(0)))) + 1).alias("idf")).checkpoint()
    other = F.log(F.lit(1.0 + n)) + 1
    weights = templates.join(F.broadcast(idf), "term").withColumn("w", F.col("c") * F.col("idf"))
    lengths = weights.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    # At most as many rows as the templates have terms: they are broadcast.
    weights = weights.join(F.broadcast(lengths), "k").select(F.col("term").alias("wt"), "k", "licence", (F.col("w") / F.col("l")).alias("w")).checkpoint()
    valued = tf.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", other))
    length = valued.groupBy("s", "t").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    dots = valued.join(F.broadcast(weights), F.col("term") == F.col("wt")).groupBy("s", "t", "k", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("d"))
    named = dots.join(length, ["s", "t"]).withColumn("score", F.floor(F.col("d") / F.col("l") * 1e6 + 0.5) / 1e6).groupBy("s", "t", "licence").agg(F.max("score").alias("score"))
    best = named.groupBy("s", "t").agg(F.max(F.struct("score", "licence")).alias("b"), F.sort_array(F.collect_list("score"), False).alias("all")).filter(F.col("b.score") >= THRESHOLD)
    best = best.select("s", "t", F.col("b.score").alias("score"), F.when(F.col("b.score") - F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0.0)) >= MARGIN, F.col("b.licence")).alias("licence"))
    found = stored(best.withColumnsRenamed({"s": "bs", "t": "bt"}), "licences-best")
    rows = dealt_join(cut.select("row", seg[0].alias("s"), seg[1].alias("t")), found, (F.col("s") == F.col("bs")) & (F.col("t") == F.col("bt")), F.col("row"))
    wide = F.coalesce(F.col("licence").isin(*WIDER) & (F.col("score") >= WIDER_FROM), F.lit(False))
    return rows.groupBy("row").agg(F.max(F.struct(wide.alias("wide"), "score", F.col("licence").isNotNull().alias("known"), "licence")).alias("m")).select("row", "m.score", "m.licence").filter("licence IS NOT NULL")


def ancestors(directory: Column) -> Column:
    """A directory path and all above it, as an array; the root is the empty path."""
    steps = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(F.array(F.lit("")), above)))


def scan(files: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """(key, path, licence, score, origin, directory) of each row.

    origin is "own" (of the text itself) or "inherited" from the licence file of the nearest directory above
    (then directory is set, and the score is that file's), or null with all others where nothing is known. An SPDX line scores 1. Null and
    empty texts have no licence of their own, however long a text is all of it is searched; a null path is a file in the root; of several
    licence files in a directory the best score counts, ties to the later name. Rows keep their number, repeated rows stay alike, an
    empty table gives an empty one, and other columns are ignored.
    """
    rows = files.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{path}`"), F.lit("")).alias("path"), F.col(f"`{text}`").alias("text"))
    is_file = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE)
    spdx = F.when(F.contains("text", F.lit("SPDX-License-Identifier:")), spdx_of(F.col("text")))
    near = F.col("text").rlike(NEAR)
    rows = rows.select("key", "path", spdx.alias("spdx"), is_file.alias("whole"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.when(near & spdx.isNull(), F.col("text")).alias("text"))
    slim = stored(rows.withColumn("row", F.monotonically_increasing_id()), "licences")
    best = best_licences(slim.filter("text IS NOT NULL").select("row", "text", "whole"))
    found = slim.filter("spdx IS NOT NULL").select("row", F.lit(1.0).alias("score"), F.col("spdx").alias("licence")).unionByName(best)
    found = stored(found.select(F.col("row").alias("r"), F.struct("score", "licence").alias("own")), "licences-own")
    slim = stored(slim.drop("text").join(maybe_broadcast(found), F.col("row") == F.col("r"), "left").select("key", "path", "dir", "whole", "own"), "licences-rows")
    granted = slim.filter(F.col("whole") & F.col("own").isNotNull()).groupBy(F.col("dir").alias("above")).agg(F.max("own").alias("grant"))
    granted = stored(granted.withColumnRenamed("above", "a"), "licences-grants")
    # One row for each directory, however many files it has; a grant of the root meets all of them.
    dirs = slim.filter(F.col("own").isNull()).select("dir").distinct().withColumn("above", F.explode(ancestors(F.col("dir"))))
    nearest = dealt_join(dirs, granted, F.col("above") == F.col("a"), F.col("dir")).groupBy("dir").agg(F.max_by(F.struct("above", "grant"), F.length("above")).alias("near"))
    nearest = stored(nearest.withColumnRenamed("dir", "d"), "licences-dirs")
    # A directory may hold most files.
    out = dealt_join(slim, nearest, F.col("own").isNull() & (F.col("dir") == F.col("d")), F.xxhash64("key", "path"), "left")
    mine, theirs = F.col("own").isNotNull(), F.col("near").isNotNull()
    return out.select(
        F.col("key").alias(key), "path",
        F.coalesce("own.licence", "near.grant.licence").alias("licence"), F.coalesce("own.score", "near.grant.score").alias("score"),
        F.when(mine, "own").when(theirs, "inherited").alias("origin"), F.when(~mine, F.col("near.above")).alias("directory"),
    )


def laid_out(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/a directory for each 512 ids/one for each 64/name; the first of 64 is its directory's LICENSE, the first of 512 that of the directory above."""
    k = F.col("doc_id")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(k / 512).cast("string"), F.when(k % 512 > 0, F.floor(k / 64).cast("string")))
    name = F.when(k % 64 == 0, "LICENSE").otherwise(F.concat(k.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", folder, name).alias("path"))


def oracle_sql() -> str:
    """DuckDB SQL of scan(laid_out(documents))."""
    rows = ", ".join(f"({k}, '{name}', '{t}', {c})" for k, name, t, c in template_rows())
    spdx = ", ".join(f"('{x}')" for x in SPDX)
    anchors = "[" + ", ".join(f"'{a}'" for a in ANCHORS) + "]"
    near = r"(^|[^a-z0-9])(" + "|".join(ANCHORS) + r")([^a-z0-9]|$)"
    windows = ", ".join(f"list_transform(range(0, greatest(1, len(w) - {n} + {n // 4}), {n // 4}), lambda k: w[k + 1:k + {n}])" for n in WINDOWS)
    wider = ", ".join(f"'{x}'" for x in WIDER)
    line = SPDX_LINE.replace(r"\(", "[(]")
    return rf"""
WITH tpl(k, licence, term, c) AS (VALUES {rows}), ids(name) AS (VALUES {spdx}),
f AS (SELECT row_number() OVER () AS row, doc_id, text, doc_id % 64 = 0 AS whole, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || (doc_id // 512)::VARCHAR || CASE WHEN doc_id % 512 > 0 THEN '/' || (doc_id // 64)::VARCHAR ELSE '' END AS dir,
             CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE doc_id::VARCHAR || '.txt' END AS name FROM documents),
sp AS (SELECT f.row, ids.name AS licence FROM f JOIN ids ON lower(regexp_replace(regexp_replace(regexp_extract(text, '{line}', 1), '[.]+$', ''), '(-only|-or-later|[+])$', '')) = lower(ids.name)),
cand AS (SELECT row, text, whole, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS w FROM f WHERE regexp_matches(translate(text, '{_UPPER}', '{_LOWER}'), '{near}') AND row NOT IN (SELECT row FROM sp)),
ln AS (SELECT row, regexp_extract_all(translate(x, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS w FROM (SELECT row, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '
[ 	
]*
'))) AS x FROM cand)),
wn AS (SELECT row, unnest(flatten([{windows}, CASE WHEN whole THEN [w] ELSE [] END])) AS w FROM cand),
cut AS (SELECT DISTINCT row, w FROM (SELECT * FROM ln UNION ALL SELECT * FROM wn) WHERE list_has_any(w, {anchors})),
seg AS (SELECT w, row_number() OVER () AS s FROM (SELECT DISTINCT w FROM cut)),
tok AS (SELECT s, unnest(w) AS term FROM seg UNION ALL SELECT s, term FROM (SELECT s, unnest(list_transform(range(2, len(w) + 1), lambda k: CASE WHEN regexp_full_match(w[k], '[0-9]+') THEN w[k - 1] || '~' || w[k] END)) AS term FROM seg) WHERE term IS NOT NULL),
tf AS (SELECT s, term, count(*)::DOUBLE AS n FROM tok GROUP BY s, term),
ct AS (SELECT row, unnest(w) AS term FROM cand UNION SELECT row, term FROM (SELECT row, unnest(list_transform(range(2, len(w) + 1), lambda k: CASE WHEN regexp_full_match(w[k], '[0-9]+') THEN w[k - 1] || '~' || w[k] END)) AS term FROM cand) WHERE term IS NOT NULL),
total AS (SELECT (SELECT count(*) FROM cand) + {len(TEMPLATES)} AS n),
d0 AS (SELECT term, count(*) AS d FROM tpl GROUP BY term), d1 AS (SELECT term, count(*) AS d FROM ct WHERE term IN (SELECT term FROM d0) GROUP BY term),
idf AS (SELECT d0.term, ln((1.0::DOUBLE + (SELECT n FROM total)) / (1.0::DOUBLE + d0.d + coalesce(d1.d, 0))) + 1 AS idf FROM d0 LEFT JOIN d1 ON d0.term = d1.term),
tw AS (SELECT k, licence, tpl.term, c * idf AS w FROM tpl JOIN idf ON tpl.term = idf.term), tl AS (SELECT k, sqrt(sum(w * w)) AS l FROM tw GROUP BY k),
val AS (SELECT s, tf.term, n * coalesce(idf, ln(1.0::DOUBLE + (SELECT n FROM total)) + 1) AS x FROM tf LEFT JOIN idf ON tf.term = idf.term),
len AS (SELECT s, sqrt(sum(x * x)) AS l FROM val GROUP BY s),
dot AS (SELECT s, tw.k, tw.licence, sum(x * (tw.w / tl.l)) AS d FROM val JOIN tw ON val.term = tw.term JOIN tl ON tw.k = tl.k GROUP BY s, tw.k, tw.licence),
sc AS (SELECT dot.s, licence, max(floor(d / l * 1e6 + 0.5) / 1e6) AS score FROM dot JOIN len ON dot.s = len.s GROUP BY dot.s, licence),
rk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, licence DESC) AS r, lead(score, 1, 0.0::DOUBLE) OVER (PARTITION BY s ORDER BY score DESC, licence DESC) AS next FROM sc),
bs AS (SELECT s, score, CASE WHEN score - next >= {MARGIN} THEN licence END AS licence FROM rk WHERE r = 1 AND score >= {THRESHOLD}),
br AS (SELECT row, score, licence FROM (SELECT cut.row, bs.score, bs.licence, row_number() OVER (PARTITION BY cut.row ORDER BY coalesce(bs.licence IN ({wider}) AND bs.score >= {WIDER_FROM}, false) DESC, bs.score DESC, bs.licence IS NOT NULL DESC, bs.licence DESC) AS r FROM cut JOIN seg ON cut.w = seg.w JOIN bs ON seg.s = bs.s) WHERE r = 1 AND licence IS NOT NULL),
own AS (SELECT f.doc_id, f.dir, f.name, f.whole, CASE WHEN sp.row IS NOT NULL THEN 1.0::DOUBLE ELSE br.score END AS score, coalesce(sp.licence, br.licence) AS licence FROM f LEFT JOIN sp ON f.row = sp.row LEFT JOIN br ON f.row = br.row),
gr AS (SELECT dir, score, licence FROM (SELECT dir, score, licence, row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence DESC) AS r FROM own WHERE whole AND licence IS NOT NULL) WHERE r = 1),
nr AS (SELECT doc_id, name, o.dir, g.dir AS above, g.score, g.licence, row_number() OVER (PARTITION BY doc_id, o.dir, name ORDER BY length(g.dir) DESC) AS r FROM (SELECT DISTINCT doc_id, name, dir FROM own WHERE licence IS NULL) o JOIN gr g ON o.dir = g.dir OR starts_with(o.dir, g.dir || '/'))
SELECT o.doc_id, o.dir || '/' || o.name AS path, coalesce(o.licence, n.licence) AS licence, coalesce(o.score, n.score) AS score,
       CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' END AS origin, n.above AS directory
FROM own o LEFT JOIN (SELECT * FROM nr WHERE r = 1) n ON o.doc_id = n.doc_id AND o.dir = n.dir AND o.name = n.name AND o.licence IS NULL
"""
