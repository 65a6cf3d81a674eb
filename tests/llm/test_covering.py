import itertools
import random

import pytest
import xxhash

from marginalia.llm import covering_dedup as C
from marginalia.llm.components import components


def naive(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(prints, radius=2):
    """{doc_id: smallest reachable} by comparing all pairs."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(distinct, 2):
        if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= radius:
            root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: least[find(f)] for d, f in prints}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_masks_cover_every_pair(radius):
    masks = [m & (2 ** 64 - 1) for m in C.masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        x = sum(1 << b for b in bits)
        assert any(not x & m for m in masks)
    if radius == 2:
        assert all(30 < m.bit_count() < 42 for m in masks)


@pytest.mark.parametrize("radius,limit", [(2, 24), (2, 2), (1, 24), (1, 2), (0, 24)])
def test_links_join_all_pairs(spark, monkeypatch, radius, limit):
    monkeypatch.setattr(C, "PAIR_BUCKET", limit)
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = {0, 2 ** 63} | {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) for b in base for _ in range(25)}
    signed = [x - 2 ** 64 if x >> 63 else x for x in prints]
    got = components(C.near_links(spark.createDataFrame([(x,) for x in signed], "f long"), radius)).collect()
    want = closure([(x, x) for x in signed], radius)
    # components are named by their smallest fingerprint here
    least = {}
    for f, c in want.items():
        least[c] = min(f, least.get(c, f))
    assert {r.node: r.component for r in got} == {f: least[c] for f, c in want.items() if list(want.values()).count(c) > 1}


def test_components_of_paths_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1400)] + [(5000, 5000)]
    df = spark.createDataFrame(edges + edges[:10], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
    assert components(df.limit(0)).collect() == []


def test_documents_with_odd_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", " \n", "Ä b", "ä b", "A b", "a B", long, long + " x", "one two three four", "ONE two\x0bthree four", "a b"]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)] + [(5, "A b", "x", 5)],
                               "doc_id long, text string, f string, component_id int")
    got = C.near_duplicates(df).collect()
    assert len(got) == len(texts) + 1
    prints = [(i, naive(t)) for i, t in enumerate(texts)]
    want = closure(prints)
    for r in got:
        assert r.fingerprint & (2 ** 64 - 1) == prints[r.doc_id][1]
        assert r.component_id == want[r.doc_id]
    assert C.near_duplicates(df.limit(0)).collect() == []
    kept = C.keep_one(df)
    assert kept.columns == df.columns
    # null, empty and blank texts are one group; word order and case as in the words
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 7, 9]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [(r.doc_id, naive(r.text)) for r in docs]
    want = closure(prints)
    got = C.op7(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for d, f in prints}
    assert len(got) == len(docs)


def similarity(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_copies_are_found_and_others_left(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([2, 3, 3, 7, 8])))
    common = [word() for _ in range(40)]
    text = lambda n: [rnd.choice(common) if rnd.random() < 0.5 else word() for _ in range(n)]
    bases = [text(rnd.randint(120, 500)) for _ in range(60)]
    rows, family = [], {}
    for f, base in enumerate(bases):
        for c in range(6 if f else 150):
            w = list(base)
            for _ in range(0 if not c else max(1, int(len(w) * rnd.uniform(0, 0.012)))):
                w[rnd.randrange(len(w))] = word()
            family[len(rows)] = f
            rows.append((len(rows), " ".join(w)))
    for _ in range(300):
        family[len(rows)] = len(rows) + 1000
        rows.append((len(rows), " ".join(text(rnd.randint(20, 400)))))
    got = {r.doc_id: r.component_id for r in C.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(family[d] == family[c] for d, c in got.items())  # nothing unlike is joined
    first = {}
    for d, f in family.items():
        first.setdefault(f, d)
    near = [d for d, f in family.items() if f < 1000 and d != first[f] and similarity(texts[d], texts[first[f]]) >= 0.8]
    found = sum(got[d] == got[first[family[d]]] for d in near)
    assert len(near) > 250 and found >= 0.98 * len(near)


def test_different_texts_stay_whatever_their_ids(spark):
    rnd = random.Random(5)
    text = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, b), (1, a), (None, c), (None, d), (None, c), (2, c), (3, e), (4, e + " more"), (None, e), (5, a.upper()), (1, b.upper())]
    df = spark.createDataFrame([(i, t, f"p{n}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _place string, node int").repartition(3)
    kept = C.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((repr(r.doc_id), r.text, r._place) for r in kept.collect())
    # of c's copies the one with an id stays, of b's spellings the text that comes first
    assert [x[:2] for x in got] == sorted([("1", a), ("1", b.upper()), ("2", c), ("3", e), ("None", d)])
    assert {x[2] for x in got if x[1] in (b.upper(), c, d, e)} == {"p11", "p6", "p4", "p7"}
    assert all(rows[int(x[2][1:])][1] == x[1] for x in got)
    assert C.keep_one(df.limit(0)).count() == 0


def test_passages_added_cut_and_put_in(spark):
    """Near copies by a passage of foreign words, and pairs just below 0.8: joined exactly by the share of shingles."""
    rnd = random.Random(11)
    word = lambda v: f"{v}{rnd.randrange(400)}"
    rows, pairs = [], []
    for i in range(240):
        base = [word("a") for _ in range(rnd.randint(100, 600))]
        extra = [word(rnd.choice("ab")) for _ in range(int(len(base) * rnd.uniform(0.1, 0.34)))]
        at = rnd.randrange(len(base))
        other = [base + extra, extra + base, base[:at] + extra + base[at:], base[:len(base) - len(extra)]][i % 4]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i, 2 * i + 1, similarity(rows[-2][1], rows[-1][1])))
    got = {r.doc_id: r.component_id for r in C.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(0.8 <= s < 0.85 for *_, s in pairs) > 20 and sum(0.7 < s < 0.8 for *_, s in pairs) > 20
    assert [(a, b, s) for a, b, s in pairs if (got[a] == got[b]) != (s >= 0.8)] == []


def test_parts_of_a_group_meet(spark):
    """Chains whose ends are unlike, and a hub of copies around them: the components of all pairs from 0.8 on."""
    rnd = random.Random(12)
    rows = []
    for _ in range(12):
        w = [f"w{rnd.randrange(10_000)}" for _ in range(200)]
        for _ in range(12):
            rows.append((len(rows), " ".join(w)))
            w = w[rnd.choice([15, 18, 24, 30]):] + [f"w{rnd.randrange(10_000)}" for _ in range(rnd.choice([5, 15, 18]))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if similarity(rows[a][1], rows[b][1]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in C.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert 12 < len(set(got.values())) < len(rows)


def test_near_copies_go_through_the_covering_masks(spark, monkeypatch):
    """With no band to agree on, copies within two bits of a fingerprint still meet; what is not alike stays apart."""
    import random

    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(1500)]
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join(f"v{rnd.randrange(5000)}" for _ in range(1500))]
    prints = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.simhash(C.SHINGLE)("t").alias("f")).collect()]
    assert bin((prints[0] ^ prints[1]) & (2 ** 64 - 1)).count("1") <= C.RADIUS
    plain = C.shingle_sketch
    monkeypatch.setattr(C, "shingle_sketch", lambda: lambda c: plain()(c).withField("bands", C.F.array().cast("array<long>")))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, C.near_copies(docs).collect())) == [(0, 0), (1, 0), (2, 2)]


def python_workers(plan):
    """The most Python workers that a task of the plan holds at a time; those of the plan's last stage."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return python_workers(plan.initialPlan())
    below = [python_workers(plan.children().apply(i)) for i in range(plan.children().size())]
    most, here = max((m for m, _ in below), default=0), [n for _, n in below]
    own = (max if kind == "Union" else sum)(here or [0]) + any(x in kind for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"))
    return (max(most, own), 0) if "Exchange" in kind else (max(most, own), own)


@pytest.mark.parametrize("repeated", [False, True])
def test_a_task_of_keep_one_holds_one_python_worker(spark, monkeypatch, repeated):
    """Each worker beside it is kept by the executor to the end and takes its memory."""
    plans, plain = [], C.written

    def noted(df, *paths):
        plans.append(df._jdf.queryExecution().executedPlan())
        return plain(df, *paths)

    monkeypatch.setattr(C, "written", noted)
    rnd = random.Random(4)
    rows = [(i // 2 if repeated else i, " ".join(f"w{rnd.randrange(900)}" for _ in range(40))) for i in range(40)]
    kept = C.keep_one(spark.createDataFrame(rows + [(100 + i, t) for i, t in rows[:9]], "doc_id long, text string"))
    assert kept.count() == 40
    found = [python_workers(p)[0] for p in (*plans, kept._jdf.queryExecution().executedPlan())]
    assert max(found) == 1 and found.count(1) >= 4
