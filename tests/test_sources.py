"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import graph as K
from marginalia.operators import ingest, mutate
from marginalia.sources import readers as R
from marginalia.sources import writers as W


def dump(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


@pytest.fixture
def folder(tmp_path):
    dump(tmp_path / "alpha_content_list.json", [
        {"type": "text", "text": "First paragraph that is long enough to be kept.", "page_idx": 0, "entities": ["PCI"]},
        {"type": "image", "image_caption": "a caption as one string", "img_path": "/x/y.png", "page_idx": 1},
        {"type": "image", "image_caption": ["two", "part caption"], "page_idx": 1},
        {"type": "table", "table_caption": ["T"], "page_idx": 2, "table_body": {
            "num_rows": 2, "num_cols": 2, "table_cells": [{"row": 0, "col": 0, "text": "a"}, {"row": 1, "col": 1, "text": "b"},
                                                         {"row": 9, "col": 0, "text": "out"}]}},
        {"text": "no type given, still text and long enough", "page_idx": None}])
    dump(tmp_path / "mineru_alpha_content_list.json", [{"type": "text", "text": "x" * 40}])
    dump(tmp_path / "broken_content_list.json", '[{"type": "text", "te')
    dump(tmp_path / "alpha_pages.json", ["page one", "page two"])
    return tmp_path


def test_content_lists(spark, folder):
    items = R.read_content_lists(spark, str(folder))
    rows = [r for r in items.orderBy("item_idx").collect() if r.doc_name == "alpha"]
    assert [r.item_idx for r in rows] == [0, 1, 2, 3, 4]
    assert rows[0].entities == ["PCI"] and rows[1].image_caption == ["a caption as one string"]
    assert rows[2].image_caption == ["two", "part caption"] and rows[4].type == "text"
    assert rows[3].table_body == "<table>\n<tr><td>a</td><td></td></tr>\n<tr><td></td><td>b</td></tr>\n</table>"
    left = ingest.drop_cross_engine_duplicates(items).select("doc_name").distinct().collect()
    assert [r.doc_name for r in left] == ["alpha"]
    chunks = {r.chunk_idx: r for r in ingest.items_to_chunks(items.where("doc_name = 'alpha'")).collect()}
    assert chunks[1].text == "[图片] a caption as one string" and chunks[1].image_url == "/images/y.png"
    assert chunks[1].source == "alpha [p.1, image]" and chunks[4].source == "alpha [p.?]"


def test_corrupt_files_become_dead_letters(spark, folder, tmp_path):
    good, bad = R.split_corrupt(R.read_whole_files(spark, f"{folder}/*_content_list.json"))
    assert good.count() == 2 and [r.file for r in bad.collect()] == ["broken_content_list.json"]
    W.write_dead_letters(bad, str(tmp_path / "dead"))
    assert spark.read.json(str(tmp_path / "dead")).first().fallback_strategy == "manual_review"
    assert W.placeholder_items(bad).first().text == "[解析失败] broken_content_list.json: invalid JSON"


def test_pages(spark, folder):
    assert [tuple(r) for r in R.read_pages(spark, str(folder)).orderBy("page_idx").collect()] == [("alpha", 0, "page one"), ("alpha", 1, "page two")]


def test_key_value_stores(spark, tmp_path):
    dump(tmp_path / "e.json", {"aspirin": {"count": 3, "create_time": 9, "chunk_ids": ["c"]}, "x": {}, "skip": "text"})
    dump(tmp_path / "r.json", {"A <SEP> B<SEP>C": {"count": 2}, "no separator": {"count": 1}})
    dump(tmp_path / "d.json", {"d1": {"file_path": "f.pdf"}, "d2": {"file_path": "f.pdf"}, "d3": {"status": "ok"}})
    e = {r.name: r for r in R.read_kv_entities(spark, str(tmp_path / "e.json")).collect()}
    assert set(e) == {"aspirin", "x"} and (e["x"]["count"], e["x"].create_time, e["x"].chunk_ids) == (1, 0, [])
    r = R.read_kv_relations(spark, str(tmp_path / "r.json")).collect()
    assert [(x.source, x.target, x["count"]) for x in r] == [("A", "B<SEP>C", 2)]
    docs = R.read_doc_status(spark, str(tmp_path / "d.json"))
    stats = K.graph_stats(K.build_nodes(R.read_kv_entities(spark, str(tmp_path / "e.json"))),
                          K.build_edges(R.read_kv_relations(spark, str(tmp_path / "r.json"))), docs)
    totals = {x.name: x.n for x in stats.where("kind = 'total'").collect()}
    assert totals == {"nodes": 2, "edges": 1, "entity_types": 2, "docs": 2}


def test_graphml(spark, tmp_path):
    dump(tmp_path / "g.graphml", """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d1" for="edge" attr.name="weight" attr.type="double"/>
<key id="d0" for="node" attr.name="source_id" attr.type="string"/>
<graph edgedefault="undirected"><node id="A">
  <data key="d0">c1&lt;SEP&gt;c2</data>
</node>
<node id="B">
  <data key="d0">c3</data>
</node>
<edge source="A" target="B">
  <data key="d1">2.5</data>
</edge>
</graph></graphml>""")
    nodes, edges = R.read_graphml(spark, str(tmp_path / "g.graphml"))
    got = {r.id: r.v for r in nodes.select("id", R.multi_value("attributes", "source_id").alias("v")).collect()}
    assert got == {"A": ["c1", "c2"], "B": ["c3"]}
    e = edges.first()
    assert (e.source, e.target, e.attributes) == ("A", "B", {"weight": "2.5"})


def test_audit_round_trip(spark, tmp_path):
    ev = spark.createDataFrame([("0123456789abcdef", "f.pdf")], "uuid string, filename string")
    W.append_audit(ev, "parse_start", str(tmp_path / "log"))
    W.append_audit(spark.createDataFrame([("q" * 200, "m")], "question string, model string"), "agent_query", str(tmp_path / "log"))
    (tmp_path / "log" / "bad.txt").write_text("not json\n{\"type\": \"api\", \"ts\": \"2026-01-01T00:00:00+00:00\", \"duration_ms\": 5}\n")
    log = R.read_audit(spark, str(tmp_path / "log"))
    assert {r.type for r in log.collect()} == {"parse_start", "agent_query", "api"}
    p = R.audit_fields(log, "parse_start", "uuid string, engine string").first()
    assert (p.uuid, p.engine) == ("0123456789ab", "mineru25pro")
    assert len(R.audit_fields(log, "agent_query", "question string").first().question) == 120
    with pytest.raises(ValueError):
        W.audit_rows(ev, "upload")
    assert len(W.AUDIT_EVENTS) == 25


def test_kb_round_trip(spark, folder, tmp_path):
    chunks = ingest.build_chunks(R.read_content_lists(spark, str(folder)))
    W.save_kb(chunks, str(tmp_path / "kb"), 4)
    back = R.load_kb(spark, str(tmp_path / "kb")).drop("bucket")
    assert sorted(map(repr, back.select(*sorted(back.columns)).collect())) == sorted(map(repr, chunks.select(*sorted(back.columns)).collect()))


def test_items_pages_and_report_writers(spark, folder, tmp_path):
    items = R.read_content_lists(spark, str(folder))
    W.write_items(items, str(tmp_path / "items"))
    assert spark.read.json(str(tmp_path / "items")).count() == items.count()
    W.write_pages(R.read_pages(spark, str(folder)), str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 2
    W.write_report(spark.createDataFrame([(1, 0.5)], "n int, rate double"), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first().value) == {"n": 1, "rate": 0.5}


def test_missing_store_and_bad_json(spark, tmp_path):
    dump(tmp_path / "e.json", "{broken")
    assert R.read_kv_entities(spark, str(tmp_path / "e.json")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.read_kv_entities(spark, str(tmp_path / "none.json")).count()


def test_graph_status(spark, tmp_path):
    dump(tmp_path / "e.json", {"CT scan": {"count": 2}, "zzz": {}})
    dump(tmp_path / "r.json", {"CT scan<SEP>zzz": {}})
    dump(tmp_path / "bad.json", "{oops")
    read = lambda e, r: R.read_graph(spark, str(tmp_path / e), str(tmp_path / r))
    nodes, edges, status = read("e.json", "r.json")
    assert {r.id: (r.grp, r.weight) for r in nodes.collect()} == {"CT scan": ("check", 2), "zzz": ("other", 1)}
    assert (edges.count(), status.first().error) == (1, None)
    nodes, edges, status = read("none.json", "r.json")
    assert (nodes.count(), edges.count(), status.first().error) == (0, 0, "storage_not_found")
    assert read("e.json", "bad.json")[2].first().error == "parse_error"


def test_snapshot_and_delta(spark):
    n = spark.createDataFrame([("a", 5), ("b", 9)], "id string, create_time bigint")
    e = spark.createDataFrame([("a", "b", 7)], "source string, target string, create_time bigint")
    snap = K.graph_snapshot(n, e)
    assert snap.first().since == 9 and K.graph_delta(n, snap).count() == 0
    later = n.union(spark.createDataFrame([("c", 10), ("d", 0)], n.schema))
    assert [r.id for r in K.graph_delta(later, snap).collect()] == ["c"]
    zero = K.graph_snapshot(n.limit(0), e.limit(0))
    assert zero.first().since == 0 and K.graph_delta(later, zero).count() == 0


def test_task_update_white_list(spark):
    tasks = spark.createDataFrame([("a", "received")], "task_uuid string, status string")
    with pytest.raises(ValueError, match="retry_count"):
        mutate.update_tasks(tasks, tasks.withColumn("retry_count", F.lit(1)))
