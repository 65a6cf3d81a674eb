import math
import re
from collections import Counter

import pytest

from marginalia.llm import licenses as L


def paragraphs(text):
    """Line by line: comment lines and others apart, signs off, lines of a paragraph joined."""
    out, now, kind = [], [], None
    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        m = re.match(L.COMMENT, line)
        if now and line and bool(m) != kind or m and kind is False and not now:
            out.append(now)
            now = []
        kind = bool(m)
        bare = re.sub(L.COMMENT_END, "", line[m.end():] if m else line)
        if bare.strip(" \t"):
            now.append(bare)
        elif now:
            out.append(now)
            now = []
    return [" ".join(x.strip(" \t") if 0 < i else x.rstrip(" \t") for i, x in enumerate(p)) for p in [*out, now] if p]


def wrapped(text):
    blocks = paragraphs(text)
    units = {s for b in blocks for s in re.split(L.CUT, b)}
    units |= {r for i, b in enumerate(blocks) if re.search(L.ANCHOR, b) for n in range(1, L.RUN + 1)
              if i + n <= len(blocks) and len(r := " ".join(blocks[i:i + n])) <= L.RUN_CHARS}
    return units


def brute(rows, templates=L.TEMPLATES):
    """{(doc_id, path): (license, score, origin, directory)} by plain loops."""
    words = lambda t: re.findall(L.TERM, (t or "").lower())
    n = len(rows)
    vocabulary = {t for _, x in templates for t in words(x)}
    df = Counter(t for _, _, x in rows for t in set(words(x)) & vocabulary)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}

    def vector(t, foreign):
        return {w: c * idf.get(w, foreign) for w, c in Counter(words(t)).items()}

    def best(t, foreign):
        u = vector(t, foreign)
        norm = math.sqrt(sum(x * x for x in u.values()))
        out = []
        for name, x in templates:
            v = vector(x, 0)
            dot = sum(u.get(w, 0) * y for w, y in v.items())
            if dot:
                out.append((-round(dot / norm / math.sqrt(sum(y * y for y in v.values())), 9), name))
        return min(out, default=None)

    own = {}
    for d, p, t in rows:
        file = header = None
        if t and re.search(L.ANCHOR, t):
            parts = [best(s, 0.0) for s in {*re.split(L.CUT, t), *wrapped(t)} if re.search(L.ANCHOR, s)]
            header = min((b for b in parts if b and -b[0] >= L.HEADER_AT), default=None)
            w = best(t, math.log(1 + n) + 1)
            file = w if w and -w[0] >= L.FILE_AT else header if p and re.search(L.FILE_NAME, p) else None
        own[d, p, t] = header, file
    given = {}
    for (d, p, t), (_, file) in own.items():
        if file and p:
            folder = p.rpartition("/")[0]
            given[folder] = min(file, given.get(folder, file))
    out = {}
    for (d, p, t), (header, file) in own.items():
        if file or header:
            b = file or header
            out[d, p] = (b[1], -b[0], "file" if file else "header", None)
        else:
            out[d, p] = (None, None, None, None)
            folder = p.rpartition("/")[0] if p is not None else None
            while folder is not None:
                if folder in given:
                    out[d, p] = (given[folder][1], -given[folder][0], "inherited", folder)
                    break
                folder = folder.rpartition("/")[0] if folder else None
    return out


def compare(df, rows):
    want, got = brute(rows), df.collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id, r.path]
        assert (r.license, r.origin, r.directory) == (w[0], w[2], w[3]), (r, w)
        assert r.score == w[1] or r.score == pytest.approx(w[1], abs=1e-7)
    return {r.doc_id: r for r in got}


def test_headers_files_and_directories(spark):
    long = "word and more " * 30_000
    rows = [(1, "a/LICENSE", L._MIT), (2, "a/b/c.txt", "plain words"), (3, "a/b/LICENSE.md", "intro\nLicensed under the Apache License, Version 2.0.\n" + long),
            (4, "a/b/x/y/z.txt", "nothing here"), (5, "a/h.txt", "text before. This work is licensed under the GNU General Public License, version 3. after"),
            (6, "q/none.txt", "nothing"), (7, None, "Licensed under CC BY-NC 4.0."), (8, "a/n.txt", None), (9, "a/e.txt", ""), (10, "top.txt", long),
            (11, "p/whole.txt", L._BSD3), (12, "p/sub/t.txt", "abc"), (13, "ab/c.txt", "the license"), (14, "p/sub/u.txt", "mit dem Hund"),
            (15, "g/f.txt", L._GPL.format("", "2")), (16, "g/f2.txt", L._GPL.format("Lesser ", "3")), (17, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:3]], "doc_id long, path string, text string, license string, key int")
    got = compare(L.scan(df), rows + rows[:3])
    assert (got[2].license, got[2].origin) == ("Apache-2.0", "inherited") and got[4].directory == "a/b"
    assert got[5].license == "GPL-3.0" and got[7].license == "CC-BY-NC-4.0" and got[8].license == "MIT" and got[10].license is None
    assert got[12].license == "BSD-3-Clause" and got[13].license is None and got[16].license == "LGPL-3.0" and got[15].license == "GPL-2.0"


def folded(text, width, sign, end="", gap=None):
    """A notice wrapped into comment lines; ``gap`` sets a blank comment line after every so many sentences."""
    import textwrap
    parts = [text] if gap is None else [" ".join(x) for x in (lambda s: [s[i:i + gap] for i in range(0, len(s), gap)])(re.split(r"(?<=[.:])\s+", text))]
    return f"\n{sign}\n".join("\n".join(f"{sign} {x}{end}" for x in textwrap.wrap(p, width)) for p in parts)


def test_wrapped_notices_in_longer_files(spark):
    code = "\n".join(f"def f{i}(the, of, to):\n    return the + of * to  # and {i}" for i in range(60))
    prose = "\n".join(f"The work of the {i} people and the rest of them is to be found in the house." for i in range(40))
    notices = {"MIT": L._MIT, "BSD-2-Clause": L._BSD2, "BSD-3-Clause": L._BSD3, "ISC": L._ISC, "GPL-3.0": L._GPL.format("", "3"), "LGPL-2.1": L._GPL.format("Lesser ", "2.1")}
    rows, want = [], {}
    for name, text in notices.items():
        for head, tail, sign, end in (("#!/bin/sh\n", "\n" + code, "#", ""), ("/*\n", "\n */\n" + code, " *", ""), (prose + "\n\n", "\n\n" + prose, "", ""),
                                      (code + "\n", "\n" + code, "//", ""), ("<!--\n", "\n-->\n" + prose, "", "  "), (";; x\n;;\n", "\n(defun x ())", ";;", "")):
            for width, gap in ((60, None), (72, 2)):
                want[len(rows)] = name
                rows.append((len(rows), f"p{len(rows)}/f.c", head + folded(text, width, sign, end, gap) + tail))
    for text in (code, prose, "# the copyright of this code\n# belongs to the authors, all rights\n# reserved\n" + code, "/* no license here */\n" + prose):
        rows.append((len(rows), f"p{len(rows)}/f.c", text))
    got = compare(L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)), rows)
    assert {d: got[d].license for d in range(len(rows))} == {d: want.get(d) for d in range(len(rows))}


def test_paragraphs_equal_the_plain_reading(spark):
    import random
    rnd = random.Random(3)
    bits = ["/* ", " * ", " */", "// ", "# ", "", "", " ", "\t", "text here. ", "more; ", "license", "-- ", "<!-- ", "-->", "dnl ", "dnlx ", "remark", ";; ", "* "]
    texts = ["\n".join("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    texts += ["a\r\nb\r\r\nc", "", "\n\n", "# only"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    clean = lambda ps: [p.strip(" \t") for p in ps if p.strip(" \t\n")]
    for r in df.select("i", "text", L.unwrapped(df.text).alias("p")).collect():
        assert clean(r.p) == clean(paragraphs(r.text)), r.text


def test_empty_table_and_bad_templates(spark):
    df = spark.createDataFrame([], "doc_id long, path string, text string")
    assert L.scan(df).collect() == []
    with pytest.raises(ValueError):
        L.scan(df, [("X", "no such word in it")])


def test_query(spark, sf):
    rows = [(r.doc_id, f"{r.source}/{r.lang}/{r.doc_id}.txt", r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = compare(L.op6(spark, sf), rows)
    for d, _, t in rows:
        if "Released under the MIT License." in t:
            assert got[d].license == "MIT" or "Apache" in t or "GNU" in t or "CC BY" in t
