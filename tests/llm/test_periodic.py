import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marginalia.llm import periodic

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every run, period by period: maximal stretches of equal words q apart, without those of a smaller period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                part = words[i:i + length]
                smaller = any(all(part[x] == part[x + d] for x in range(length - d)) for d in range(1, q))
                if length >= max(6, 4 * q) and not smaller:
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = SPLIT.findall(text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    df = periodic.op12(spark, sf)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 6 + ["string"] * 2
    got = rows(df)
    assert got == sorted((plain(r.doc_id, r.text) for r in docs), key=repr)
    assert sum(r[1] > 0 for r in got) >= 10


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_of_random_words(letters):
    rnd = random.Random(letters)
    for _ in range(400):
        words = [rnd.randrange(letters) for _ in range(rnd.randint(0, 70))]
        if rnd.random() < 0.6:  # a planted run, its last period cut, and another one right behind
            for _ in range(rnd.randint(1, 3)):
                root = [rnd.randrange(letters) for _ in range(rnd.randint(1, 17))]
                at = rnd.randint(0, len(words))
                words[at:at] = (root * 7)[:rnd.randint(3 * len(root), 6 * len(root))]
        got = [tuple(map(int, r)) for r in periodic.runs_of(np.array(words, np.int64))]
        assert got == plain_runs(words), words


@pytest.mark.parametrize("q", [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65])
def test_shortest_runs_at_every_place(q):
    least = max(6, 4 * q)
    for shift in range(0, 2 * q + 5):
        words = list(range(1000, 1000 + shift)) + [i % q for i in range(least)] + list(range(2000, 2000 + 9))
        assert periodic.runs_of(np.array(words)).tolist() == [[shift, least, q]]
        words.pop(shift)  # one word less is no run
        assert periodic.runs_of(np.array(words)).tolist() == []


def test_wavelet_matrix_equals_a_scan():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 300):
        values = rnd.permutation(n)
        lo = rnd.integers(0, n, 200)
        hi = np.minimum(n, lo + rnd.integers(0, n + 1, 200))
        least = rnd.integers(0, n + 3, 200)
        want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(lo, hi, least)]
        assert periodic.WaveletMatrix(values).successor(lo, hi, least).tolist() == want


def test_documents_searched_together_do_not_meet():
    texts = [b"a b", b"a b a b a b a", b"", b"b a b a b a b a b", b"x " * 5, b"x " * 6, b"\x0b".join([b"p", b"q"] * 9), b"caf\xc2\xa0e " * 7]
    for together in (1, 4, 20, 10**6):
        got = [(words, [tuple(map(int, r)) for r in runs]) for words, runs in periodic._searched(texts, together)]
        assert [w for w, _ in got] == [t.split() for t in texts]
        assert [r for _, r in got] == [plain_runs(t.split()) for t in texts]


def test_odd_rows(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    docs += [(None, "no id " * 9), (None, None), (3, docs[3][1]), (3, docs[3][1]), (900, ""), (901, None), (902, " \t\n\x0b\x0c\r "),
             (903, "\x1c\x85\xa0 " * 8), (904, "é 北 " * 12)]
    docs += [(905, " ".join(str(i % 5000) for i in range(9_999)) + " end" * 7)]
    schema = "doc_id bigint, text string, runs string, collapsed string, n_words string"
    df = spark.createDataFrame([(i, t, "r", "c", "n") for i, t in docs], schema).repartition(3)
    out = periodic.periodic_runs(df)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    want = []
    for i, t in docs[:-1]:
        words = SPLIT.findall(t or "")
        runs = plain_runs(words)
        gone = {x for s, length, q in runs for x in range(s + q, s + length)}
        want.append((i, len(words), runs, " ".join(w for x, w in enumerate(words) if x not in gone)))
    long = docs[-1][1].split()
    want.append((905, len(long), [(9_999, 7, 1)], " ".join(long[:10_000])))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_planted_words_follow_the_rule(spark):
    from pyspark.sql import functions as F
    docs = [(i, " ".join(f"w{j}" for j in range(i % 57))) for i in range(400)] + [(None, "a b c"), (None, None), (38, None), (38, " ")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = df.select("doc_id", "text", periodic.planted(F.col("text"), F.col("doc_id")).alias("new")).collect()
    changed = 0
    for r in got:
        h, words = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()), SPLIT.findall(r.text or "")
        if h % 10 or not words:
            assert SPLIT.findall(r.new or "") == words
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.new.split(" ") == [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        changed += 1
    assert changed > 20
