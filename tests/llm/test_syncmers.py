import hashlib
import random

import pytest
import xxhash

from marginalia.llm import syncmers as S


def grams(text):
    return text.encode("utf-32-be")


def h(raw):
    x = xxhash.xxh64_intdigest(raw, 42)
    return x - 2 ** 64 if x >> 63 else x


def naive_anchors(text):
    b, out = grams(text), []
    for i in range(len(text) - S.K + 1):
        inner = [h(b[4 * (i + j):4 * (i + j + S.S)]) for j in range(S.K - S.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(b[4 * i:4 * (i + S.K)])))
    return out


def sketch(text):
    found = naive_anchors(text)
    cells = {}
    for _, x in found:
        u = x & (2 ** 64 - 1)
        cells[u % S.CELLS] = min(u >> 6, cells.get(u % S.CELLS, 2 ** 60))
    if found:
        return [f"{cells[c] & 0xffff:04x}" if c in cells else S.EMPTY for c in range(S.CELLS)]
    return None


def like(a, b):
    some = [(x, y) for x, y in zip(a, b) if x != S.EMPTY or y != S.EMPTY]
    return sum(x == y for x, y in some) / max(1, len(some))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    out = []
    for n, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        out.append((d, t, edited, nxt))
    return out


def compare(df, rows):
    want = brute(rows)
    got = sorted(df.collect(), key=lambda r: (r.doc_id, r.n_chars))
    assert len(got) == len(want)
    for r, (d, t, edited, nxt) in zip(got, sorted(want, key=lambda w: (w[0], len(w[1])))):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = sketch(t), sketch(edited), sketch(nxt)
        if a:
            assert r.fingerprint == "".join(a)
        if b:
            assert r.edited_fingerprint == "".join(b)
        if t == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
        if a and b:
            assert r.near_edited == pytest.approx(like(a, b))
        if a and c:
            assert r.near_next == pytest.approx(like(a, c))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    return got


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_blocks_and_odd_texts(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "BLOCKS", blocks)
    rnd = random.Random(1)
    texts = [None, "", "a", "abcdefghijk", "abcdefghijkl", "naïve 北京 🎉 " * 30, "x" * 3000, words(rnd, 4000), "same text of some length", "same text of some length"]
    texts += [words(rnd, rnd.randint(1, 80)) for _ in range(60)]
    rows = [(i * i - 5, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, key string")
    got = {r.doc_id: r for r in compare(S.fingerprints(df), rows)}
    assert got[8 * 8 - 5].fingerprint == got[9 * 9 - 5].fingerprint and got[8 * 8 - 5].near_next == 1.0
    assert got[-5].fingerprint == got[-4].fingerprint  # null and empty
    assert got[-1].fingerprint != got[4].fingerprint


def test_few_rows_and_repeats(spark):
    schema = "doc_id long, text string"
    assert S.fingerprints(spark.createDataFrame([], schema)).collect() == []
    lone = S.fingerprints(spark.createDataFrame([(7, "one single document here")], schema)).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    same = S.fingerprints(spark.createDataFrame([(7, "one single document here")] * 3 + [(None, "no id at all here")], schema)).collect()
    assert len(same) == 4 and sum(r.near_next == 1.0 for r in same) == 2


def test_anchors_are_context_free(spark):
    rnd = random.Random(4)
    inside = words(rnd, 40)
    df = spark.createDataFrame([(1, inside), (2, words(rnd, 30) + inside + words(rnd, 30)), (3, None)], "doc_id long, text string")
    found = S.anchors(df).collect()
    for d, t in df.collect():
        assert sorted((r.position, r.hash) for r in found if r.doc_id == d) == naive_anchors(t or "")
    own = {(r.position, r.hash) for r in found if r.doc_id == 1}
    shift = df.collect()[1].text.index(inside)
    assert own <= {(r.position - shift, r.hash) for r in found if r.doc_id == 2}


def test_likeness_follows_the_overlap(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, words(rnd, 300)) for i in range(30)], "doc_id long, text string")
    for r in S.fingerprints(df).collect():
        assert 0.15 < r.near_edited < 0.55 and r.near_next < 0.15


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(S.op8(spark, sf), rows)
