"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Texts that hold an anchor word are cut into lines and sentences, and, as notices are wrapped over
lines and set in comments, into unwrapped sentences, paragraphs and runs of paragraphs (headers); they
are also taken whole (licence files). Weights are term counts times inverse document frequency, counted over all documents. A header is
compared in the space of template terms, so words around a notice cost nothing; a whole text is
compared with all its words, so only a text that is a licence passes. What has no licence of its own
takes that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import checkpointed, query, table

HEADER_AT, FILE_AT = 0.65, 0.8
#: Bound of the templates' vocabulary, which is broadcast.
MOST_TERMS = 20_000
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
ANCHOR = (r"(?i)licen[cs]|copyright|spdx|warrant|creative commons|\bcc[ -]?(?:by|0)|public domain|redistribut|permission|liable|"
          r"free software")
CUT = r"\n+|(?<=[.!?;])\s+"
#: What a comment line starts with, and what may end it.
COMMENT = r"[ \t]*(?:/\*+!?|\*+/?|//+!?|#+|;+|--+|%+|<!--|-->|(?:dnl|DNL|rem|REM|Rem)(?![A-Za-z0-9]))"
COMMENT_END = r"[ \t]*(?:\*+/|-->)[ \t]*$"
#: Paragraphs of a run, and characters of one: no notice is longer. Lines and sentences have no bound.
RUN, RUN_CHARS = 5, 6000
#: Tasks that the files of one directory are spread over.
SALTS = 16
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)[^/]*$"

# ---- fixed values: notices and texts of common licences ----
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        'publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, '
        'subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or '
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        'BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE '
        'AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, '
        'ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.')
_ISC = ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that '
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        'ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.')
_BSD2 = ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions '
         'are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. '
         'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the '
         'documentation and/or other materials provided with the distribution.')
_BSD3 = _BSD2 + (' Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products '
                 'derived from this software without specific prior written permission.')
_GPL = ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as '
        'published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.')
TEMPLATES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT license"), ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   'License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", _GPL.format("", "2")),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", _GPL.format("", "3")),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-2.1", _GPL.format("Lesser ", "2.1")), ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", _GPL.format("Lesser ", "3")), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", _GPL.format("Affero ", "3")), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD3), ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", _ISC), ("ISC", "Licensed under the ISC License."), ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal, dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# ---- end of fixed values ----


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def unwrapped(text: Column) -> Column:
    """The paragraphs of a text, comment signs and line ends taken out. Comments and what is around them are apart."""
    own = F.regexp_replace(text, r"\r\n?", "\n")
    apart = F.regexp_replace(own, rf"(?md)^({COMMENT}[^\n]*\n)(?!{COMMENT})", "$1\n")
    apart = F.regexp_replace(apart, rf"(?md)^(?!{COMMENT})([^\n]+\n)(?={COMMENT})", "$1\n")
    bare = F.regexp_replace(F.regexp_replace(apart, rf"(?md)^{COMMENT}", ""), f"(?md){COMMENT_END}", "")
    blocks = F.split(bare, r"\n[ \t]*(?:\n[ \t]*)+")
    return F.transform(blocks, lambda b: F.regexp_replace(b, r"[ \t]*\n[ \t]*", " "))


def wrapped_units(text: Column) -> Column:
    """Sentences of the unwrapped paragraphs, and runs of up to ``RUN`` paragraphs from one with an anchor word on."""
    def cut(blocks: Column) -> Column:
        sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, CUT)))
        runs = F.flatten(F.transform(blocks, lambda b, i: F.when(b.rlike(ANCHOR), F.transform(
            F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(blocks) - i)), lambda n: F.array_join(F.slice(blocks, i + 1, n), " "))).otherwise(
            F.array().cast("array<string>"))))
        return F.concat(sentences, F.filter(runs, lambda r: F.length(r) <= RUN_CHARS))

    return F.get(F.transform(F.array(unwrapped(text)), cut), F.lit(0))  # a list of one binds the paragraphs


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each of the templates' terms (bounded by ``MOST_TERMS``), over all texts."""
    known = F.array(*map(F.lit, sorted(vocabulary)))
    held = docs.select(F.explode_outer(F.array_intersect(terms(F.coalesce("text", F.lit(""))), known)).alias("term"))
    counted = {r.term: r["count"] for r in held.groupBy("term").count().collect()}
    return docs.count(), {t: counted.get(t, 0) for t in vocabulary}


def weighted_templates(templates: Sequence[tuple[str, str]], n: int, seen: dict[str, int]):
    """Rows ``(template, license, term, idf, weight)``; weights of a template have length 1."""
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in seen.items()}
    for i, (name, text) in enumerate(templates):
        count = Counter(re.findall(TERM, text.lower()))
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in count.items()))
        for t, c in sorted(count.items()):
            yield i, name, t, idf[t], c * idf[t] / norm


def similar_units(units: DataFrame, templates: Sequence[tuple[str, str]], n: int, seen: dict[str, int]) -> DataFrame:
    """``(key, pos, license, score)``: each unit's best template by cosine.

    Units are ``(key, pos, text)``; at ``pos`` -1, a whole text, foreign terms count with the largest
    idf, elsewhere only the templates' terms do. Ties go to the licence first in the alphabet.
    """
    spark = units.sparkSession
    rows = list(weighted_templates(templates, n, seen))
    table_ = F.broadcast(spark.createDataFrame([(i, name, t, w) for i, name, t, _, w in rows], "template int, license string, term string, w double"))
    idf = F.broadcast(spark.createDataFrame(sorted({(t, x) for _, _, t, x, _ in rows}), "term string, idf double"))  # bounded by MOST_TERMS
    foreign = F.when(F.col("pos") == -1, math.log(1 + n) + 1).otherwise(0.0)
    counted = (units.select("key", "pos", F.explode(terms(F.col("text"))).alias("term")).groupBy("key", "pos", "term").agg(F.count("*").alias("tf"))
               .join(idf, "term", "left").select("key", "pos", "term", (F.col("tf") * F.coalesce("idf", foreign)).alias("u")))
    vectors = checkpointed(counted)
    norms = vectors.groupBy("key", "pos").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    dots = vectors.join(table_, "term").groupBy("key", "pos", "template", "license").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    scored = dots.join(norms, ["key", "pos"]).select("key", "pos", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = scored.groupBy("key", "pos").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("x"))
    return best.select("key", "pos", "x.license", (-F.col("x.s")).alias("score"))


def scan(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, path: str = "path", text: str = "text",
         doc_id: str = "doc_id", header_at: float = HEADER_AT, file_at: float = FILE_AT) -> DataFrame:
    """``(doc_id, path, license, score, origin, directory)`` for every row.

    ``origin`` is ``file`` (the text is a licence, or its name says so and it holds one), ``header``
    (a line, a sentence or a run of paragraphs is one, wrapped or not), ``inherited`` from ``directory``, or null. Null and empty texts have
    no licence of their own; a null path is in no directory; repeated rows get equal results; an empty
    table gives no rows; other columns are ignored.
    """
    vocabulary = sorted({t for _, x in templates for t in re.findall(TERM, x.lower())})
    if len(vocabulary) > MOST_TERMS:
        raise ValueError(f"templates hold {len(vocabulary)} terms, more than {MOST_TERMS}")
    lost = [x for _, x in templates if not re.search(ANCHOR, x)]
    if lost:
        raise ValueError(f"a template without an anchor word would never be found: {lost[0][:60]}")
    docs = files.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), F.col(text).alias("text"))
    n, seen = document_frequencies(docs, vocabulary)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("path", F.lit("")), F.xxhash64("text"))
    named = docs.withColumn("key", key)
    marked = named.where(F.col("text").rlike(ANCHOR)).select("key", "text")
    lines = marked.select("key", F.posexplode(F.split("text", CUT)).alias("pos", "text")).where(F.col("text").rlike(ANCHOR))
    # what the lines did not give already
    more = F.filter(F.array_except(wrapped_units(F.col("text")), F.split("text", CUT)), lambda x: x.rlike(ANCHOR))
    wrapped = marked.select("key", F.posexplode(more).alias("pos", "text")).withColumn("pos", F.col("pos") + (1 << 30))
    units = lines.unionAll(wrapped).unionAll(marked.select("key", F.lit(-1), "text"))
    best = similar_units(units, templates, n, seen)
    own = checkpointed(best.groupBy("key").agg(
        F.min(F.when((F.col("pos") >= 0) & (F.col("score") >= header_at), F.struct((-F.col("score")).alias("s"), "license"))).alias("header"),
        F.min(F.when((F.col("pos") == -1) & (F.col("score") >= file_at), F.struct((-F.col("score")).alias("s"), "license"))).alias("file"))
        .where("header is not null or file is not null"))
    narrow = checkpointed(named.select("doc_id", "path", "key").join(own, "key", "left")
                          .withColumn("file", F.coalesce("file", F.when(F.col("path").rlike(FILE_NAME), F.col("header"))))
                          .withColumn("dir", F.regexp_extract("path", r"^(.*)/", 1)))
    # nearest directory above, worked out once per directory
    given = narrow.where("file is not null and dir is not null").groupBy(F.col("dir").alias("directory")).agg(F.min("file").alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("directory")))
    dirs = narrow.where("dir is not null and header is null and file is null").select("dir").distinct().select("dir", F.explode(above).alias("x")).select("dir", "x.*")
    near = dirs.join(given, "directory").groupBy("dir").agg(F.max_by(F.struct("directory", "given"), "depth").alias("near"))
    # a directory's one row is repeated, so that the files of a hot directory meet it in several tasks
    spread = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = narrow.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(spread, ["dir", "salt"], "left")
    mine = F.coalesce("file", "header")
    told = F.coalesce(mine, F.col("near.given"))
    origin = F.when(F.col("file").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited")
    return rows.select("doc_id", "path", told["license"].alias("license"), (-told["s"]).alias("score"), origin.alias("origin"),
                       F.when(mine.isNull(), F.col("near.directory")).alias("directory"))


@query("op6_license_scan")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text"))
