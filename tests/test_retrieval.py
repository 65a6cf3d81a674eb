"""Vector search against brute force, and the batch-size and model-chain ways out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import lookups as L
from marginalia.operators import model_map as M
from marginalia.operators import retrieval as Q


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 16))
    v[350:] = v[:350]  # every vector twice: all scores tie
    q = rng.normal(size=(9, 16))
    vectors = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in enumerate(v)],
                                    "vec_id bigint, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in row]) for i, row in enumerate(q)],
                                    "query_id string, embedding array<double>")
    scores = np.round(q @ v.astype(np.float32).astype(np.float64).T, 12)
    want = {}
    for i in range(9):
        order = np.lexsort((np.arange(700), -scores[i]))
        want[f"q{i}"] = [(int(j), round(float(scores[i, j]), 9)) for j in order[:6]]
    return queries, vectors, want


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return out


def test_topk_equals_brute_force_with_ties(data):
    queries, vectors, want = data
    assert ranked(Q.topk_inner_product(queries, vectors, 6, None)) == want


def test_topk_in_slices(data):
    queries, vectors, want = data
    assert ranked(Q.topk_inner_product(queries, vectors, 6, None, max_rows=3)) == want


def test_any_number_of_queries_in_one_plan(data, spark):
    """Beyond the bound, in small Arrow batches, with many groups, unsound rows left out."""
    queries, vectors, want = data
    odd = spark.createDataFrame([(9001, [1.0] * 15), (9002, [float("nan")] * 16), (9003, None), (9004, [float("inf")] * 16), (9005, [None] * 16)],
                                "vec_id bigint, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 23)
    try:
        got = ranked(Q.topk_inner_product(queries, vectors.unionByName(odd), 6, None, max_rows=2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_repeated_ids_mean_the_same_at_every_size(data, spark):
    """Rows of one id ask together: a vector found counts once, with its best score."""
    queries, vectors, _ = data
    one = queries.withColumn("query_id", F.when(F.col("query_id") < "q6", "hot").otherwise(F.col("query_id")))
    rows = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    asked = {}
    for r in one.collect():
        asked.setdefault(r.query_id, []).append(np.array(r.embedding))
    want = {}
    for q, many in asked.items():
        score = {v: max(round(float(x @ e), 12) for x in many) for v, e in rows.items()}
        want[q] = [(v, round(s, 9)) for v, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:6]]
    assert ranked(Q.topk_inner_product(one, vectors, 6, None)) == want
    assert ranked(Q.topk_inner_product(one, vectors, 6, None, max_rows=3)) == want


def test_a_hot_id_in_a_large_batch(data, spark):
    queries, vectors, want = data
    first = queries.where("query_id = 'q0'").select(F.lit("q0").alias("query_id"), "embedding")
    many = first.join(spark.range(9000), F.lit(True)).select("query_id", "embedding")
    assert ranked(Q.topk_inner_product(many, vectors, 6, None)) == {"q0": want["q0"]}


def test_topk_with_small_batches(data, spark):
    queries, vectors, want = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        assert ranked(Q.topk_inner_product(queries, vectors, 6, None)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_threshold_applies_after_the_cut(data):
    queries, vectors, want = data
    got = ranked(Q.topk_inner_product(queries, vectors, 6, 8.0))
    assert got == {q: kept for q, hits in want.items() if (kept := [h for h in hits if h[1] > 8.0])}


def test_larger_k_is_a_superset(data):
    queries, vectors, _ = data
    small = {(r.query_id, r.vec_id) for r in Q.topk_inner_product(queries, vectors, 3, None).collect()}
    large = {(r.query_id, r.vec_id) for r in Q.topk_inner_product(queries, vectors, 9, None).collect()}
    assert small < large


def test_no_queries_no_hits(data):
    queries, vectors, _ = data
    assert Q.topk_inner_product(queries.where("false"), vectors, 3).count() == 0


def test_file_match_is_containment(spark):
    files = spark.createDataFrame([("ab.pdf",), ("abc.pdf",), ("x.pdf",), ("b c.pdf",)], "file_name string")
    docs = spark.createDataFrame([("zabz",), ("q b c",)], "doc_name string")
    got = {r.file_name: r.status for r in L.match_files(files, docs).collect()}
    assert got == {"ab.pdf": "indexed", "abc.pdf": "uploaded", "x.pdf": "uploaded", "b c.pdf": "indexed"}


def test_single_document_routes_everything(spark):
    answers = spark.createDataFrame([(1, "ALL"), (2, "other")], "query_id int, answer string")
    docs = spark.createDataFrame([("only",), ("only",)], "doc_name string")
    assert sorted(map(tuple, L.route_queries(answers, docs).collect())) == [(1, "only"), (2, "only")]
    two = docs.union(spark.createDataFrame([("other",)], "doc_name string"))
    assert list(map(tuple, L.route_queries(answers, two).collect())) == [(2, "other")]


def test_unrouted_queries_keep_all_hits(spark):
    hits = spark.createDataFrame([(1, "docA [p.1]"), (1, "docB [p.1]"), (2, "docB [p.2]")], "query_id int, source string")
    targets = spark.createDataFrame([(1, "docA"), (1, "docB [p.1] and more")], "query_id int, target string")
    assert L.filter_hits_by_doc(hits, targets).count() == 3
    assert L.filter_hits_by_doc(hits, targets.limit(1)).count() == 2


def test_section_filter_falls_back(spark):
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, None)], "query_id int, section_tag string")
    got = Q.filter_by_section(hits, ["a"]).groupBy("query_id").count()
    assert {r.query_id: r["count"] for r in got.collect()} == {1: 2, 2: 2}


def test_model_chain_retries_then_falls_back():
    waits, calls = [], []

    def bad(prompt):
        calls.append(prompt)
        raise ValueError("no")

    r = M.call_with_fallback([("a", bad), ("b", lambda p: p.upper())], "x", retries=3, sleep=waits.append)
    assert r == {"success": True, "data": "X", "error": None, "retries": 0, "model": "b", "fallback": True}
    assert waits == [1.0, 2.0, 4.0] and len(calls) == 4
    waits.clear()
    M.call_with_fallback([("a", bad)], "x", retries=7, sleep=waits.append)
    assert waits == [1.0, 2.0, 4.0, 8.0, 16.0, 30.0, 30.0]


def test_cache_answers_when_models_fail(spark):
    df = spark.createDataFrame([(1, "known"), (2, "new")], "id int, p string")
    def down(prompt):
        raise RuntimeError("down")

    cache = df.where("id = 1").select(F.md5(F.left("p", F.lit(500))).alias("prompt_md5"), F.lit("stored").alias("data"))
    got = {r.id: (r.success, r.data, r.model, r.error) for r in M.model_map(df, "p", "id", [("m", down)], cache, retries=0).collect()}
    assert got == {1: (True, "stored", "cache", None), 2: (False, None, "m", "down")}


def test_vision_map_reads_bytes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    images = spark.read.format("binaryFile").load(str(tmp_path))
    assert M.vision_map(images, [("v", lambda b: str(len(b)))]).first().data == "5"


def test_embedding_is_normalised_and_batched(spark):
    def encoder(texts):
        assert len(texts) <= 16
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.range(50).select("id", F.repeat(F.lit("a"), (F.col("id") % 5).cast("int")).alias("t")).coalesce(1)
    rows = Q.batch_embed(df, "t", encoder).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in rows)


def test_nodes_of_wiki_without_links_have_zero(spark):
    notes = spark.createDataFrame([(1, "A", "[[b]] [[B]] [[A]]"), (2, "B", "[[a]]"), (3, "C", "[[none]]")], "id int, title string, content string")
    assert {r.id: r.link_count for r in L.wiki_graph(notes).collect()} == {1: 1, 2: 1, 3: 0}
    assert [tuple(r) for r in L.backlinks(notes, notes.where("id = 2").select("title")).collect()] == [("B", 1)]


def test_query_model_upper_cases_like_sql():
    import duckdb

    from marginalia.plans.stream_queries import _flaky
    texts = ["erßie", "ŉab", "ᾳx", "ﬁn", "ǆabc", "und so weiter"]
    want = [duckdb.execute("SELECT upper(left(?, 5))", [t]).fetchone()[0] for t in texts]
    assert [_flaky(t) for t in texts] == want


def test_equal_query_vectors_are_searched_once(spark, monkeypatch):
    """More queries than are shipped, with three vectors between them: no groups are needed."""
    monkeypatch.setattr(Q, "_meet", None)
    rnd = np.random.default_rng(4)
    v, few = rnd.normal(size=(300, 8)), rnd.normal(size=(3, 8))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = [(f"q{i}", i % 3) for i in range(40)] + [("q0", 1), ("both", 0), ("both", 2)]
    queries = spark.createDataFrame([(q, few[x].tolist()) for q, x in asked], "query_id string, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in Q.topk_inner_product(queries, vectors, 4, None, max_rows=10).collect())
    want = []
    for q in {q for q, _ in asked}:
        best = np.round(np.max([few[x] @ v.T for n, x in asked if n == q], axis=0), Q.SCORE_DIGITS)
        want += [(q, place + 1, int(i)) for place, i in enumerate(np.lexsort((np.arange(300), -best))[:4])]
    assert got == sorted(want)


def test_hashed_terms_count_words_by_place(spark):
    from hashlib import md5
    texts = ["The the cat sat\x1csat", "", None, "ein Straßenfest 　 ÄÖ ﬁn 😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plan = Q.batch_embed(rows, "t")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan  # a text is split and counted once, not once a place
    for r in Q.batch_embed(rows, "t").collect():
        want = np.zeros(64)
        for w in (r.t or "").lower().split():
            want[int(md5(w.encode()).hexdigest()[:6], 16) % 64] += 1
        assert r.embedding == (want / max(1.0, np.sqrt((want * want).sum()))).tolist()


def test_queries_that_meet_groups_are_copied_by_the_root_of_the_tasks(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(90, 4))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 36)
    try:
        found = Q._meet(asked, vectors, 2, 4)
        assert found.count() <= 90 * 6 * 2  # each query meets six groups in one of six parts; 36 groups gave up to 72 hits a query before
        assert found.groupBy("query_id", "vec_id").count().where("count > 1").count() == 0
        top = Q.topk_inner_product(asked, vectors, 2, None, max_rows=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {(r.query_id, r["rank"]): r.vec_id for r in top.collect()}
    order = np.argsort(-(v @ v.T), axis=1)
    assert got == {(q, n + 1): int(order[q, n]) for q in range(90) for n in range(2)}
