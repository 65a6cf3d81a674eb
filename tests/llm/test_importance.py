import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from marginalia.llm import importance

SCHEMA = "doc_id bigint, text string, score string, rank string, key string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, most=1):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=10, least=20, most=1, size=10000):
    """Rows (doc_id, n_features, weight, score, rank) document by document."""
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s, t = [0] * size, [0] * size
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in runs(x, most):
                counts[bucket(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + size) / ((s[b] + 1) * (big_t + size)))) for b in range(size)]
    out = []
    for i, text in docs:
        f = runs(text, most)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, x) in zip(out, docs) if len(words(x)) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = importance.op13(spark, sf)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert got(df) == plain(docs, target)


def test_odd_rows(spark):
    rnd = random.Random(3)
    vocabulary = ["alpha", "BETA", "été", "naïve", "x1", "北京", "İ", "o'clock", " ", "\x85", "\x1c", "_", "end."]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(150)]
    docs += [(None, text(40)), (None, None), (7, docs[7][1]), (7, docs[7][1]), (500, ""), (501, None), (502, "word " * 60000), (503, "a" * 70000)]
    docs += [(600, "same words here " * 9)] * 40  # one row repeated: drawn one by one
    df = spark.createDataFrame([(i, x, "s", "r", "k") for i, x in docs], SCHEMA).repartition(5)
    target = ["alpha alpha x1", None, "", "北京"]
    out = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert got(out) == plain(docs, target)
    assert importance.resample(df.limit(0), df).count() == 0
    none = importance.resample(df, spark.createDataFrame([], "text string"))
    assert got(none) == plain(docs, [])
    few = importance.resample(df.where("doc_id < 5"), df)
    assert few.where("rank is not null").count() == 0 and few.count() == 5


@pytest.mark.parametrize("most", [1, 2, 3])
def test_runs_over_piece_borders(most):
    rnd = random.Random(most)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "bc", " ", "  ", "É", "-", "D"]) for _ in range(rnd.randint(0, 80)))
        want = sorted(zlib.crc32(f.encode()) % 997 for f in runs(text, most))
        parts = list(importance.feature_buckets(text.encode(), most, 997, piece=rnd.randint(1, 20)))
        assert sorted(int(b) for _, p in parts for b in p) == want
        assert sum(n for n, _ in parts) == len(words(text))


def test_kth_key_of_any_table(spark):
    rnd = random.Random(1)
    values = rnd.sample(range(-10**6, 10**6), 700)
    keys = spark.createDataFrame([((v // 1000, v),) for v in values], "key struct<a:bigint,b:bigint>").repartition(6)
    for k in (1, 2, 350, 699, 700):
        assert importance.kth_key(keys, k, pivots=4).b == sorted(values)[k - 1]
    assert importance.kth_key(keys, 701, pivots=4) is None and importance.kth_key(keys, 0) is None


def test_draw_prefers_the_target(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(["sea", "ship", "sail"] if i % 10 == 0 else ["tax", "law", "court", "judge"]) for _ in range(30)))
            for i in range(1000)]
    out = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string"),
                              spark.createDataFrame([("sea ship sail " * 50,)], "text string"))
    assert [r.doc_id % 10 for r in out.where("rank is not null").collect()] == [0] * 100


def test_gains_are_counts_of_whole_corpora():
    gain = importance.gains(np.array([0, 9]), np.array([9, 0]))
    assert gain.tolist() == [math.floor(1000 * math.log(10)), math.floor(1000 * math.log(0.1))]
