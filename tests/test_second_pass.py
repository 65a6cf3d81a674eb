"""Searches that depend on a first one, counts that come with a pass, and the whole set of audit events."""

import json

from pyspark.sql import functions as F

from marginalia.operators import chunking as C
from marginalia.operators import evidence as E
from marginalia.operators import retrieval as Q
from marginalia.sources import writers as W

PASSAGES = {1: "heart failure randomized trial with open-label arms", 2: "heart surgery cohort adjusted", 3: "liver transplant case report",
            4: "kidney stones randomized double-blind study", 5: "heart valve guideline"}


class Encoder:
    """Word-hash vectors; remembers the texts it was given, call by call."""

    def __init__(self):
        self.calls = []

    def __call__(self, df, text):
        self.calls.append(sorted(r[0] for r in df.select(text).collect()))
        return Q.batch_embed(df, text).select("query_id", "embedding")


def stored(spark):
    chunks = spark.createDataFrame([(i, f"doc{i}", f"doc{i} [p.1]", t) for i, t in PASSAGES.items()], "vec_id bigint, doc_name string, source string, text string")
    return Q.batch_embed(chunks, "text").select("vec_id", "embedding"), chunks


def test_only_topics_without_documents_are_searched(spark):
    vectors, chunks = stored(spark)
    requests = spark.createDataFrame([
        (1, "liver transplant", ["heart failure", "heart surgery"]), (2, "kidney stones", ["   "]), (3, "kidney stones", []), (4, "", [""]),
        (5, "liver transplant", ["   ", "heart failure"])], "request_id int, topic string, doc_names array<string>")
    encode = Encoder()
    got = {}
    for r in E.grade_requests(requests, encode, vectors, chunks).collect():
        got.setdefault(r.request_id, {})[r.doc_id] = r
    assert encode.calls == [["", "   ", "heart failure", "heart surgery"], ["", "kidney stones"]]
    assert {k: sorted(v) for k, v in got.items()} == {1: ["heart failure", "heart surgery"], 2: [E.WHOLE_TOPIC], 3: [E.WHOLE_TOPIC],
                                                      4: [E.WHOLE_TOPIC], 5: ["heart failure"]}
    assert got[1]["heart failure"].final_level == got[5]["heart failure"].final_level
    assert got[2][E.WHOLE_TOPIC].initial_level == 4  # its passages speak of a randomized study
    assert got[4][E.WHOLE_TOPIC].initial_level == 2  # graded on no text
    profile = {r.request_id: r.total_assessed for r in E.grade_profile(E.grade_requests(requests, Encoder(), vectors, chunks), ["request_id"]).collect()}
    assert profile == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    none = E.grade_requests(requests.where("false"), Encoder(), vectors, chunks)
    assert none.count() == 0


def test_documents_are_graded_by_what_their_names_find(spark):
    vectors, chunks = stored(spark)
    docs = spark.createDataFrame([("heart failure", "rct"), ("  ", "cohort")], "doc_name string, evidence_type string")
    got = {r.doc_id: (r.initial_level, r.risk_of_bias < 0) for r in E.grade_corpus(docs, Encoder(), vectors, chunks).collect()}
    assert got == {"heart failure": (4, True), "  ": (2, False)}


def test_documents_are_graded_by_whole_passages(spark):
    vectors, chunks = stored(spark)
    late = "x" * 900 + " no blinding, i2=75"
    longer = chunks.withColumn("text", F.concat("text", F.lit(late)))
    # two names and two designs share what they find, one name comes twice, one without a design, one is no name
    docs = spark.createDataFrame([("heart failure", "rct"), ("heart failure", "rct"), ("heart failure", "cohort"), ("heart failure heart failure", None),
                                  ("  ", "cohort"), (None, "rct")], "doc_name string, evidence_type string")
    encode = lambda df, text: Q.batch_embed(df, text).select("query_id", "embedding")
    got = sorted(((r.doc_id or "", r.initial_level, r.inconsistency) for r in E.grade_corpus(docs, encode, vectors, longer).collect()))
    assert got == [("", 4, 0), ("  ", 2, 0), ("heart failure", 2, -1), ("heart failure", 4, -1), ("heart failure", 4, -1), ("heart failure heart failure", 2, -1)]
    cut = {r.doc_id: r.inconsistency for r in E.grade_corpus(docs, encode, vectors, longer, keep=800).collect()}
    assert set(cut.values()) == {0}


def test_only_weak_answers_are_searched_again(spark):
    vectors, chunks = stored(spark)
    asked = spark.createDataFrame([(1, "liver transplant case of a child with more words ?"), (2, "heart failure"), (3, "heart valve guideline and so on"),
                                   (4, "   "), (5, "kidney stones")], "query_id int, text string")
    step = "array<struct<tool:string,result_preview:string>>"
    found, nothing = [("search_rag", "ok")], [("search_rag", "未找到")]
    good = "来源 [1] " + "a long and well founded answer " * 5
    answers = spark.createDataFrame([(1, good, nothing), (2, good, found), (3, good + "tool_call", found), (4, good, [])], f"query_id int, answer string, steps {step}")
    encode = Encoder()
    targets = spark.createDataFrame([(2, "doc2")], "query_id int, target string")
    hits, judged = Q.search_again(asked, answers, encode, vectors, chunks, targets, k=3, k_again=2)
    assert encode.calls[1] == ["heart valve guideline and so", "liver transplant case of a"] and len(encode.calls[0]) == 5
    assert {r.query_id: r.confidence for r in judged.collect()} == {1: "low", 2: "high", 3: "low", 4: "low"}
    rows = {}
    for r in hits.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r)
    first = {r.query_id: r for r in Q.doc_aware_retrieve(Encoder()(asked, "text"), vectors, chunks, targets, 3).where("rank = 1").collect()}
    again = {1: "liver transplant case of a", 3: "heart valve guideline and so"}
    second = {r.query_id: r for r in Q.doc_aware_retrieve(Encoder()(spark.createDataFrame(list(again.items()), "query_id int, text string"), "text"),
                                                          vectors, chunks, targets, 2).where("rank = 1").collect()}
    for q in (1, 3):
        best = max(first[q].score if q in first else 0, second[q].score)
        assert rows[q][0].score == best and rows[q][0].search == (2 if best > (first[q].score if q in first else 0) else 1)
    assert {r.vec_id for r in rows[2]} == {2} and {r.search for q in (2, 5) for r in rows[q]} == {1}
    for q, of in rows.items():
        assert [r.rank for r in of] == list(range(1, len(of) + 1)) and len({r.vec_id for r in of}) == len(of)
        assert [r.score for r in of] == sorted((r.score for r in of), reverse=True)


def test_counts_come_with_the_pass(spark, tmp_path):
    body = "<table><tr><td>" + "cell " * 20 + "</td></tr></table>"
    long = "a text of more than eighty characters that neither joins its neighbour nor a table, since it is " + "long " * 60
    rows = [("a", 0, "text", long + "/zero.pl.tnum", 0, None), ("a", 1, "text", "Caption", 0, None), ("a", 2, "table", None, 0, body),
            ("a", 3, "text", "short", 1, None), ("a", 4, "text", "next\x00", 1, None), ("b", 0, "table", None, 0, body), ("b", 1, "table", None, 0, "tiny"),
            ("b", 2, "image", "/one.case", 0, None), ("b", 3, "equation", "x = 1", 0, None), ("b", 4, "table", None, 0, body)]
    path = str(tmp_path / "items")
    spark.createDataFrame(rows, "doc_name string, item_idx bigint, type string, text string, page_idx bigint, table_body string").write.parquet(path)
    made = spark.createDataFrame([("a", 1, " a paragraph "), ("b", 0, None), ("b", 1, "not used"), ("b", 2, "a figure"), ("b", 3, "not used")],
                                 "doc_name string, item_idx bigint, text string")
    out, counts = C.postprocess_items(spark.read.parquet(path), made)
    got = {(r.doc_name, r.item_idx): (r.type, r.text, r.merged, r.serialized) for r in out.collect()}
    assert counts() == {"cleaned": 2, "merged": 2, "serialized": 2}
    assert got == {("a", 0): ("text", long + "0", False, False), ("b", 3): ("equation", "x = 1", False, False), ("b", 4): ("table", None, False, False),
                   ("a", 1): ("table", "[表格序列化] a paragraph", True, True),
                   ("a", 3): ("text", "short next", True, False), ("b", 0): ("table", "[表] \n" + body[:500], False, False),
                   ("b", 1): ("table", None, False, False), ("b", 2): ("image", "[图表序列化] a figure", False, True)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 1  # the items are read once
    plain, counts = C.postprocess_items(spark.read.parquet(path))
    plain.write.format("noop").mode("overwrite").save()
    assert counts() == {"cleaned": 2, "merged": 2, "serialized": 0}


def test_every_kind_of_event_has_its_fields(spark, tmp_path):
    given = {f: f"{f} " * 200 for fields in W.AUDIT_EVENTS.values() for f in fields}
    given |= {"step": 3, "elapsed": 0.25, "success": False, "context": {"a": [1, {"b": None}]}, "pico_types": {"P": 2}}
    lines = [(k, json.dumps(given)) for k in W.AUDIT_EVENTS] + [("parse_start", '{"uuid": "0123456789abcdef", "filename": "f"}'), ("agent_error", '{"error": null}'),
                                                                ("error", '{"error": "e"}'), ("unknown", "{}"), ("login", "no json"), ("logout", None)]
    log = spark.createDataFrame(lines, "type string, payload string").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = [json.loads(r.value) for r in W.audit_lines(log).collect()]
    assert len(got) == len(lines) - 1 and all(g["ts"] == "2024-01-02T03:04:05.000000Z" for g in got)
    for g, kind in zip(got, W.AUDIT_EVENTS):
        fields = W.AUDIT_EVENTS[kind]
        assert list(g) == ["ts", "type", *fields] and g["type"] == kind
        for f in fields:
            cut = W._cut(kind, f)
            assert g[f] == (given[f][:cut] if cut else given[f])
    assert got[25:28] == [{"ts": got[0]["ts"], "type": "parse_start", "uuid": "0123456789ab", "filename": "f", "engine": "mineru25pro"},
                          {"ts": got[0]["ts"], "type": "agent_error", "step": 0}, {"ts": got[0]["ts"], "type": "error", "error": "e", "context": {}}]
    as_variant = W.audit_lines(log.withColumn("payload", F.try_parse_json("payload")))
    assert [json.loads(r.value) for r in as_variant.collect()] == got
    # as a stream
    log.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("type string, payload string, ts timestamp").json(str(tmp_path / "in"))
    q = W.audit_lines(stream).writeStream.format("text").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(r.value for r in W.audit_lines(log).collect())


def test_passages_are_embedded_once_for_both_searches(spark, sf):
    from marginalia.plans import QUERIES
    plan = QUERIES["search_again"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    read = [line for line in plan.splitlines() if "FileScan" in line and "documents.parquet" in line]
    assert read and not [line for line in read if "text:string" in line.split("ReadSchema")[1]]  # texts were read before, to be embedded


def test_empty_words_at_the_ends_of_texts_do_not_count(spark):
    import numpy as np
    from marginalia.operators.retrieval import _word_counts
    import pyarrow as pa
    texts = ["  cat sat ", "", " \t ", "cat", "x" * 200 + " cat　"]
    assert _word_counts(pa.array(texts), 64).sum(axis=1).tolist() == [len(t.split()) for t in texts]
    assert np.array_equal(_word_counts(pa.array(["cat sat"]), 64), _word_counts(pa.array(["  sat cat"]), 64))
    assert _word_counts(pa.array([], pa.string()), 64).shape == (0, 64)


def test_passages_are_embedded_and_read_once_for_topics(spark, sf):
    from marginalia.plans import QUERIES
    for name in ("estimate_grade_requests", "estimate_grade_profile"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert sum("FileScan" in line and "documents.parquet" in line for line in plan.splitlines()) == 1  # four before: two searches, embedded


def test_events_are_dealt_over_the_cores_before_payloads_are_made(spark, sf):
    from marginalia.plans import QUERIES
    assert QUERIES["audit_all_events"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
