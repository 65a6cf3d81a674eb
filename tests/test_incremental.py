"""Updates against a step-by-step model, with a hash that most rows share and one large document."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import incremental as N
from marginalia.operators import ingest

PHRASES = [f"paragraph number {i} with enough letters to pass" for i in range(25)]
ITEM = ("doc_name string, item_idx bigint, type string, text string, page_idx bigint, image_caption array<string>, "
        "table_caption array<string>, table_body string, img_path string")


def items_of(spark, docs):
    rows = [(d, i, "text", t, i // 3, None, None, None, None) for d, texts in docs.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ITEM).repartition(3)


def step(stored, doc, texts):
    """One document re-ingested: keep matches, drop the rest of it, add what nobody has."""
    kept = {t for d, t in stored if d == doc and t in texts}
    out = {(d, t) for d, t in stored if d != doc or t in kept}
    have = {t for _, t in out}
    fresh = {t for t in texts if t not in have and len(t) > 30}
    return out | {(doc, t) for t in fresh}, (len(kept), len([1 for d, t in stored if d == doc and t not in kept]), len(fresh))


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_the_model(spark, seed):
    from marginalia.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    rnd = random.Random(seed)
    draw = lambda n: [PHRASES[0] if rnd.random() < 0.35 else rnd.choice([*PHRASES, "short"]) for _ in range(n)]
    first = {"hot": draw(60), **{f"d{i}": draw(4) for i in range(6)}}
    table = ingest.build_chunks(items_of(spark, first)).checkpoint()
    model, seen = set(), set()
    for d in sorted(first):
        for t in first[d]:
            if len(t) > 30 and t not in seen:
                seen.add(t)
                model.add((d, t))
    assert {(r.doc_name, r.text) for r in table.collect()} == model
    for doc in ("hot", "d3", "new"):
        texts = draw(40 if doc == "hot" else 5)
        state, counts = N.upsert_documents(table, items_of(spark, {doc: texts}))
        model, (kept, stale, added) = step(model, doc, texts)
        table = state.checkpoint()
        rows = table.collect()
        assert {(r.doc_name, r.text) for r in rows} == model and len(rows) == len(model)
        c = {r.doc_name: (r.kept, r.stale, r.added) for r in counts.collect()}
        assert c.get(doc, (0, 0, 0)) == (kept, stale, added)


def test_known_hashes_of_other_partitions_count(spark):
    none = ingest.build_chunks(items_of(spark, {"x": ["short"]}))
    known = spark.createDataFrame([(PHRASES[1],)], "t string").select(F.md5("t").alias("content_md5"))
    state, _ = N.upsert_documents(none, items_of(spark, {"a": PHRASES[:3]}), known=known)
    assert {r.text for r in state.collect()} == {PHRASES[0], PHRASES[2]}


def test_skip_known_keeps_the_first_of_the_batch(spark):
    docs = spark.createDataFrame([("b", "h1"), ("a", "h1"), ("c", "h2"), ("d", "h3")], "doc_name string, doc_md5 string")
    known = spark.createDataFrame([("h3",)], "doc_md5 string")
    assert sorted(r.doc_name for r in N.skip_known_documents(docs, known).collect()) == ["a", "c"]


def test_removal_leaves_other_ids(spark):
    v = spark.createDataFrame([(1, "a"), (5, "b"), (9, "a")], "vec_id bigint, doc_name string")
    gone = spark.createDataFrame([("a",), ("a",)], "doc_name string")
    assert [r.vec_id for r in N.remove_documents(v, gone).collect()] == [5]
    assert N.next_vector_id(v).first().next_id == 10 and N.next_vector_id(v.limit(0)).first().next_id == 0


def test_kept_chunks_move_with_the_new_version(spark):
    """Insertion and removal at the front: positions are those of the new version, each once."""
    a, b, c, d = PHRASES[:4]
    table = ingest.build_chunks(items_of(spark, {"x": [a, b, d]}))
    state, counts = N.upsert_documents(table, items_of(spark, {"x": [c, a, b]}))
    assert sorted((r.chunk_idx, r.text) for r in state.collect()) == [(0, c), (1, a), (2, b)]
    assert [(r.kept, r.stale, r.added) for r in counts.collect()] == [(2, 1, 1)]
    again, counts = N.upsert_documents(state, items_of(spark, {"x": [c, a, b]}))
    assert sorted((r.chunk_idx, r.text) for r in again.collect()) == [(0, c), (1, a), (2, b)]
    assert [(r.kept, r.stale, r.added) for r in counts.collect()] == [(3, 0, 0)]
    less, _ = N.upsert_documents(state, items_of(spark, {"x": [b]}))
    assert [(r.chunk_idx, r.text) for r in less.collect()] == [(0, b)]
