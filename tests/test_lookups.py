"""Containment joins against the plain comparison of everything with everything."""

import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.operators import lookups as L


def test_containments_equal_brute_force(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    names = {word(rnd.randint(0, 25)) for _ in range(150)} | {"", "Customer#000000001", "Customer#000000012"}
    stems = {word(rnd.randint(0, 9)) for _ in range(80)} | {"", "Customer#", "Customer#000000001", "0012", "tomer#0000", "x"}
    got = L.containments(spark.createDataFrame([(s,) for s in stems for _ in range(2)], "_stem string"),
                         spark.createDataFrame([(n,) for n in names] + [(None,)], "_name string")).collect()
    assert sorted(map(tuple, got)) == sorted((s, n) for s in stems if s for n in names if s in n)


def test_a_long_name_gives_as_many_pieces_as_it_is_long(spark):
    n = spark.createDataFrame([("ab" * 500 + "needle",)], "_name string")
    assert L.containments(spark.createDataFrame([("bneedle",)], "_stem string"), n).count() == 1
    assert n.select(L._grams(n["_name"], L.GRAM).alias("g")).first().g.__len__() <= 1006


def test_terms_equal_brute_force(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    texts = [(i, i % 2, word(rnd.randint(0, 60))) for i in range(120)] + [(900, 0, None), (901, 0, "")]
    terms = [word(rnd.randint(0, 9)) for _ in range(150)] + [None, "", "zzz", "a"] * 2
    got = L.match_terms(spark.createDataFrame(texts, "a int, b int, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), ["a", "b"])
    want = sorted((a, b, t) for a, b, x in texts for t in set(terms) if t and x and t in x)
    assert sorted(map(tuple, got.collect())) == want and want


def test_fifty_thousand_keywords(spark):
    """Rules as rows: the first rule with a keyword in the lower-cased start of the text."""
    rnd = random.Random(2)
    rules = [(i, f"L{i % 11}", f"Key{i * 7919 % 50_000:05d}") for i in range(50_000)] + [(60_000, "late", "key00000"), (-1, "never", "")]
    texts = [(i, " ".join(rnd.choice(["filler", "kEy%05d" % rnd.randrange(50_000), "key"]) for _ in range(rnd.randint(0, 12)))) for i in range(300)]
    place = {}
    for p, label, k in rules:
        if k:
            place[k.lower()] = min(place.get(k.lower(), (p, label)), (p, label))
    want = []
    for i, t in texts:
        low = t[:60].lower()
        hits = [place[low[j:j + 8]] for j in range(len(low)) if low[j:j + 8] in place]
        want.append((i, min(hits)[1] if hits else "none"))
    df = spark.createDataFrame(texts, "id int, text string")
    got = L.classify_by_table(df, spark.createDataFrame(rules, "place int, label string, keyword string"), ["id"], default="none", prefix=60)
    assert sorted((r.id, r.label) for r in got.collect()) == want and len({w for _, w in want}) > 5


def test_topics_as_rows_and_as_a_list_agree(spark):
    e = spark.createDataFrame([(f"d{i}", "T", i % 7, {"population": f"group {i}"}, [f"finding {i} about Asthma" if i % 3 else "other", "x" * i])
                               for i in range(40)], "doc_name string, doc_title string, evidence_level int, pico map<string,string>, findings array<string>")
    topics = ["asthma", "GROUP 3", "xxxxxxxx", "", "none of them"]
    few = L.topic_evidence(e, topics)
    rows = L.topic_evidence(e, spark.createDataFrame([(t,) for t in topics], "topic string"))
    many = L.topic_evidence(e, topics + [f"no such topic {i}" for i in range(L.MAX_LITERAL_TERMS)])
    want = sorted((r.doc_name, r.topic) for r in few.collect())
    assert sorted((r.doc_name, r.topic) for r in rows.collect()) == want == sorted((r.doc_name, r.topic) for r in many.collect())
    assert len(want) > 60


def test_long_terms_equal_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("aß😀") for _ in range(n))
    texts = [(i, word(rnd.randint(0, 600))) for i in range(60)]
    cut = lambda t, n: t[(at := rnd.randrange(max(1, len(t) - n))):at + n]
    terms = {cut(rnd.choice(texts)[1], rnd.choice([1, 3, 15, 16, 17, 40, 200])) for _ in range(200)} | {word(30)}
    got = L.match_terms(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), ["id"])
    want = sorted((i, t) for i, x in texts for t in terms if t and t in x)
    assert sorted(map(tuple, got.collect())) == want and any(len(t) > 100 for _, t in want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_pieces_of_names_are_not_broadcast(spark):
    """A file of names is small, its pieces are many times as large."""
    names = spark.range(20_000).select(F.format_string("Customer#%09d", "id").alias("_name"))
    for length in (12, 18):
        stems = names.limit(50).select(F.left("_name", F.lit(length)).alias("_stem"))
        lines = _plan(L.containments(stems, names))
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                depth = line.index("BroadcastExchange")
                below = [x for x in lines[at + 1:]]
                end = next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))
                assert not any("Generate explode" in x for x in below[:end])


def test_short_terms_are_not_searched_again(spark):
    """Each piece of a text that is a term is a result: no second look at the texts."""
    texts = spark.createDataFrame([(i, "some words") for i in range(10)], "id int, text string")
    terms = spark.createDataFrame([("some",), ("word",)], "term string")
    lines = _plan(L.match_terms(texts, terms, ["id"]))
    assert not any("Contains(" in x for x in lines) and sum("Join" in x for x in lines) == 1


def test_early_rules_decide_alone(spark, monkeypatch):
    monkeypatch.setattr(L, "EARLY_RULES", 2)
    rules = spark.createDataFrame([(5, "e", "word"), (1, "a", "none"), (2, "b", "some"), (2, "a", "other"), (9, "z", "last")], "place int, label string, keyword string")
    texts = spark.createDataFrame([(1, "some word"), (2, "word last"), (3, "last"), (4, "nil"), (5, "other some"), (6, None)], "id int, text string")
    got = L.classify_by_table(texts, rules, ["id"], default="-")
    assert sorted((r.id, r.label) for r in got.collect()) == [(1, "b"), (2, "e"), (3, "z"), (4, "-"), (5, "a"), (6, "-")]


def test_only_pieces_that_may_be_terms_become_rows(spark, monkeypatch):
    rnd = random.Random(4)
    letters = "abc é治\U0001F600"
    texts = {i: "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 40, 400]))) for i in range(60)} | {60: None, 61: "ab" * 900}
    monkeypatch.setattr(L, "CHARS", 500, raising=False)  # several runs of a batch, and a text longer than a run
    words = {t[i:i + n] for t in texts.values() if t for n in (1, 2, 5, 16, 20) for i in [rnd.randrange(len(t))] if i + n <= len(t)}
    words |= {"nowhere", "not in any of the texts", "", "ab" * 8, "ab" * 250 + "a"}
    rows = spark.createDataFrame([(i, t, "kept") for i, t in texts.items()] * 2, "id int, text string, note string")
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    got = L.match_terms(rows.distinct(), terms, ["id"]).collect()
    want = {(i, w) for i, t in texts.items() for w in words if t and w and w in t}
    assert {(r.id, r.term) for r in got} == want and len(got) == len(want)
    # what a text has besides is never made into rows: few of its pieces come out of the search
    long = spark.createDataFrame([(1, "".join(chr(97 + rnd.randrange(26)) for _ in range(5000)))], "id int, text string")
    few = spark.createDataFrame([("qzj",), ("never",)], "term string")
    offered = L._pieces(long, ["id"], "text", few, [3, 5], "term").count()
    assert offered < 100


def test_pieces_are_told_apart_by_their_characters():
    whole, sizes, points = L._joined(["abab", "abcd"])
    row = np.repeat([0, 1], sizes)
    one = np.zeros(len(points), np.uint64)  # hashes that are all the same
    assert sorted(whole[p:p + 2] for p in L._distinct(np.array([0, 1, 2, 4, 5, 6]), 2, one, row, points)) == ["ab", "ab", "ba", "bc", "cd"]
