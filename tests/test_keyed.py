"""Per-key primitives against plain walks, also on a key with most rows."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunking as C
from marginalia.operators import keyed as K


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data, sizes = [], {"hot": 400, "a": 30, "b": 1, "c": 7}
    for key, n in sizes.items():
        at = 0
        for _ in range(n):
            at += rnd.choice([1, 1, 1, 2, 9])  # gaps, as left by filters
            data.append((key, at, rnd.choice("xyz"), rnd.randrange(50), rnd.random() < 0.6))
    return spark.createDataFrame(data, "doc_name string, idx bigint, tag string, n bigint, flag boolean").repartition(4).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))


def test_windows_equal_a_walk(rows):
    keys = ["doc_name"]
    df = K.with_run_start(K.with_running_sum(K.with_previous(rows, keys, "idx", ["tag"]), keys, "idx", "n", "s"), keys, "idx", F.col("flag"))
    got = {(r.doc_name, r.idx): r for r in K.with_position(df, keys, "idx").collect()}
    data = rows.collect()
    assert len(got) == len(data)
    for key in {r.doc_name for r in data}:
        total, before, start = 0, None, None
        for i, r in enumerate(sorted((r for r in data if r.doc_name == key), key=lambda r: r.idx)):
            g = got[key, r.idx]
            start = r.idx if r.flag else start
            assert (g.prev_tag, g.prev_idx) == ((before.tag, before.idx) if before else (None, None))
            assert (g.s, g.run_start, g.position) == (total, start, i)
            total, before = total + r.n, r


def test_pairs_are_greedy_from_the_left(rows):
    dense = K.with_position(rows, ["doc_name"], "idx", "p").select("doc_name", "p", "flag")
    want = {}
    for key, items in _by_key(dense.collect()).items():
        taken = False
        for i, r in enumerate(items):
            if taken:
                want[key, i], taken = i - 1, False
            else:
                want[key, i], taken = i, r.flag and i + 1 < len(items)
    last = dense.groupBy("doc_name").agg(F.max("p").alias("l"))
    flagged = dense.join(last, "doc_name").withColumn("flag", F.col("flag") & (F.col("p") < F.col("l"))).drop("l")
    assert {(r.doc_name, r.p): r.head for r in K.pair_up(flagged, ["doc_name"], "p", "flag").collect()} == want


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_name, r.p)):
        out.setdefault(r.doc_name, []).append(r)
    return out


def test_a_document_of_200000_rows_like_any_other(spark):
    """The rows of one large document equal those of the same document cut into small ones at page borders."""
    n, page = 200_000, 50
    base = spark.range(n).select(F.col("id").alias("chunk_idx"), F.floor(F.col("id") / page).alias("page_idx"),
                                 F.element_at(F.array(*map(F.lit, ["methods", "results", "safety"])), (F.floor(F.col("id") / 7) % 3 + 1).cast("int"))
                                 .alias("section_tag"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    def merged(doc):
        c = base.withColumn("doc_name", doc).withColumn("source", F.concat("doc_name", F.lit(" [p.0]")))
        m = C.merge_adjacent(c)
        return m, m.select("section_tag", "page_start", "merged", "text")
    one, a = merged(F.lit("big"))
    _, b = merged(F.concat(F.lit("d"), F.col("page_idx").cast("string")))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert one.agg(F.max("chunk_idx") + 1, F.count("*")).first()[0] == one.count()


def test_one_scan_and_no_job_while_planning(spark, sf):
    from marginalia.plans import QUERIES
    for name in ("merge_adjacent", "section_islands"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") + plan.count("LogicalRDD") == 1, name


def test_first_per_key_keeps_one_of_many_copies(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (3000 - F.col("id")).alias("o"), F.col("id").alias("v"))
    got = {r.k: r.v for r in K.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {0: 2998, 1: 2999}


def test_global_row_number_is_contiguous(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(6)
    rows = K.global_row_number(df, ["k"], 100).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(100, 5100))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v")).repartition(4)
    top = K.top_n_per_key(df, ["k"], [F.col("v").desc()], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.v for r in top.collect()) == [994, 995, 996, 997, 998, 999]


def test_decisions_build_the_chunks_once(spark):
    from marginalia.plans import QUERIES
    plan = QUERIES["apply_merge_decisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "md5(" not in plan  # what is left reads the written chunks
