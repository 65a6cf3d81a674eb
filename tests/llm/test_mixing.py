import random
import re
import struct
from collections import defaultdict

import pytest
import xxhash

from marginalia.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, target string, size string, place string, key string"


def h64(*numbers):
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64(struct.pack("<q", n), seed=seed).intdigest()
    return seed


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water-filled targets of ``sizes`` by source: capped ones leave, the rest share by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and left / total * weight[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else left / total * weight[s] for s in order}
        capped |= above


def plain(docs, seed=mixing.SEED):
    """(doc_id, size, source_size, target, taken) by the same steps, one document at a time."""
    size = [len(re.findall(mixing.WORD, t or "")) for _, t, _ in docs]
    total = defaultdict(int)
    for n, (_, _, s) in zip(size, docs):
        total[s] += n
    goal = targets(total) if docs else {}
    order = sorted(goal, key=lambda s: (s is None, (s or "").encode()))
    copies, line = [], []
    for i, (n, (doc, _, s)) in enumerate(zip(size, docs)):
        ratio = goal[s] / total[s] if total[s] else 0.0
        copies.append(int(ratio))
        if ratio > int(ratio) and n:
            mark = h64(doc, seed) if doc is not None else h64(seed)
            line.append((order.index(s), -n, mark - 2**64 * (mark >> 63), doc is not None, doc or 0, i, ratio - int(ratio)))
    line.sort()
    items = [(key, place, p, -less, i) for place, (key, less, _, _, _, i, p) in enumerate(line)]
    level = 0
    u = lambda *x: (h64(*x) >> 11) * 2.0**-53
    while True:
        groups = defaultdict(list)
        for x in items:
            groups[x[0], x[1] >> 6 * (level + 1)].append(x)
        items = []
        for _, members in sorted(groups.items()):
            (key, place, p, n, i), *others = members
            for _, place2, q, m, j in others:
                ratio = m / n
                up, down = min(1 - p, q * ratio), min(p, (1 - q) * ratio)
                if u(seed, level, place2) * (up + down) < down:
                    if 1 - p <= q * ratio:
                        copies[i] += 1
                        place, p, n, i = place2, q + (p - 1) / ratio, m, j
                    else:
                        p = p + q * ratio
                elif p <= (1 - q) * ratio:
                    place, p, n, i = place2, q + p / ratio, m, j
                else:
                    copies[j] += 1
                    p = p + (q - 1) * ratio
                p = min(1.0, max(0.0, p))
            items.append((key, place, p, n, i))
        level += 1
        if len(line) <= 1 << 6 * level:
            break
    for _, place, p, _, i in items:
        copies[i] += u(seed, -1, place) < p
    return sorted(((doc, n, total[s], goal[s], n * c) for (doc, _, s), n, c in zip(docs, size, copies)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def equal(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and x[3] == pytest.approx(y[3], rel=1e-12) and x[4] == y[4] for x, y in zip(a, b))


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = mixing.op11(spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert equal(got(df), plain(docs))


def made(rnd, n, sources=7):
    return [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(int(rnd.paretovariate(0.8)) % 900)), f"s{min(rnd.randrange(sources * 2), sources)}") for i in range(n)]


def near(rows, docs):
    """Words of a source differ from its target by less than its largest document; copies are whole, at most three."""
    source = {d: s for d, _, s in docs}
    taken, goal, largest = defaultdict(int), {}, defaultdict(int)
    for d, n, _, target, t in rows:
        s = source[d]
        assert t <= 3 * n and (t == 0 if n == 0 else t % n == 0)
        taken[s] += t
        goal[s] = target
        largest[s] = max(largest[s], n)
    return all(abs(taken[s] - goal[s]) < max(1, largest[s]) + 1e-6 for s in goal)


def test_many_levels_any_partitions(spark):
    docs = made(random.Random(1), 9000)
    frames = [spark.createDataFrame([(d, t, s, "t", "z", "p", "k") for d, t, s in docs], SCHEMA).repartition(n) for n in (3, 7)]
    one, two = (got(mixing.mix(f)) for f in frames)
    assert one == two and equal(one, plain(docs)) and near(one, docs)
    other = got(mixing.mix(frames[0], seed=5))
    assert other != one and equal(other, plain(docs, 5)) and near(other, docs)


def test_odd_rows(spark):
    docs = made(random.Random(2), 300)
    docs += [(None, "a b c", None), (None, None, None), (1000, "", "only empty"), (1001, None, "only empty"), (1002, "x " * 30000, "s1"), (5, "e f", "é"), (5, "e f", "é")]
    docs += [(7777, "again and again", "s2")] * 100
    df = spark.createDataFrame([(d, t, s, "t", "z", "p", "k") for d, t, s in docs], SCHEMA)
    rows = got(mixing.mix(df))
    assert equal(rows, plain(docs))
    assert mixing.mix(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " \t", None)], "doc_id bigint, text string, source string")
    assert got(mixing.mix(blank)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_targets_are_filled_up_to_the_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 1, "e": 500, None: 40}
    sized = spark.createDataFrame([(s, 1) for s, n in sizes.items() for _ in range(n)], "source string, size bigint")
    rows = {r.source: r for r in mixing.source_targets(sized).collect()}
    want = targets(sizes)
    assert {s: r.target for s, r in rows.items()} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values())) and want["a"] == 30 and want["d"] == 3
    assert [s for s, _ in sorted(rows.items(), key=lambda x: x[1].ordinal)] == ["a", "b", "c", "d", "e", None]


def test_expected_copies_stay_as_due():
    docs = [(i, "w " * n, f"s{i % 3}") for i, n in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 55, 4, 4, 4, 9, 9, 30])]
    sums = defaultdict(int)
    for seed in range(3000):
        for d, n, size, target, taken in plain(docs, seed):
            sums[d, n, target / size] += taken // n
    for (_, _, ratio), k in sums.items():
        assert k / 3000 == pytest.approx(ratio, abs=0.04)
