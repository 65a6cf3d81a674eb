"""The stored table grows by batches: merges, killed batches, compaction, pruned reads, narrow updates."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginalia.operators import incremental as N
from marginalia.operators import ingest
from marginalia.sources import batch_log as B
from marginalia.sources import readers as R
from marginalia.sources import writers as W
from marginalia.streaming import jobs as J
from test_incremental import PHRASES, items_of, step
from test_streaming import lifecycle, walk


def stored(spark, folder):
    return sorted((r.doc_name, r.chunk_idx, r.text) for r in R.load_kb(spark, folder).collect())


def test_batches_equal_the_model_and_one_batch(spark, tmp_path):
    rnd, model, last = random.Random(3), set(), {}
    draw = lambda n: [PHRASES[0] if rnd.random() < 0.3 else rnd.choice([*PHRASES, "short"]) for _ in range(n)]
    folder = str(tmp_path / "kb")
    for batch, doc in enumerate(["a", "b", "a", "c", "b", "a"]):
        texts = draw(30 if doc == "a" else 6)
        W.upsert_kb(W.kb_log(spark, folder, 4), items_of(spark, {doc: texts}), "s", batch)
        model, _ = step(model, doc, texts)
        last[doc] = texts
        rows = stored(spark, folder)
        assert {(d, t) for d, _, t in rows} == model and len(rows) == len(model)
        assert all(last[d][i] == t for d, i, t in rows)  # kept chunks stand where the newest version has them
        if batch == 3:
            W.kb_log(spark, folder).compact()
            assert stored(spark, folder) == rows
    log = W.kb_log(spark, folder)
    assert (log.last, log.base, log.parts) == (5, 3, 4)
    assert sorted(map(tuple, log.live("hashes").select("doc_name", "content_md5").collect())) == sorted(
        map(tuple, log.live("chunks").select("doc_name", "content_md5").collect()))
    log.compact()
    log.vacuum()
    assert stored(spark, folder) == rows
    assert sorted(p.name for p in (tmp_path / "kb" / "chunks").glob("seq=*")) == []
    assert [p.name for p in (tmp_path / "kb" / "chunks_base").glob("upto=*")] == ["upto=5"]
    # distinct documents with distinct texts: three batches leave what one leaves
    docs = {d: [f"{d} says {p}" for p in PHRASES[:3]] for d in "xyz"}
    for batch, (d, texts) in enumerate(docs.items()):
        W.upsert_kb(W.kb_log(spark, str(tmp_path / "three"), 4), items_of(spark, {d: texts}), "s", batch)
    W.upsert_kb(W.kb_log(spark, str(tmp_path / "one"), 4), items_of(spark, docs), "s", 0)
    assert stored(spark, str(tmp_path / "three")) == stored(spark, str(tmp_path / "one"))


def test_a_killed_batch_shows_nothing_and_is_done_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "kb")
    W.upsert_kb(W.kb_log(spark, folder, 4), items_of(spark, {"a": PHRASES[:4]}), "s", 0)
    before = stored(spark, folder)
    with monkeypatch.context() as m:
        m.setattr(B.BatchLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            W.upsert_kb(W.kb_log(spark, folder), items_of(spark, {"a": PHRASES[5:9], "z": PHRASES[9:12]}), "s", 1)
    assert stored(spark, folder) == before
    for _ in range(2):  # the batch again, less than it was; and once more after its commit
        W.upsert_kb(W.kb_log(spark, folder), items_of(spark, {"a": PHRASES[2:6]}), "s", 1)
        assert {t for _, _, t in stored(spark, folder)} == set(PHRASES[2:6])
    assert W.kb_log(spark, folder).last == 1
    with monkeypatch.context() as m:  # a compaction that is killed before its pointer
        m.setattr(B.BatchLog, "_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            W.kb_log(spark, folder).compact()
    assert W.kb_log(spark, folder).base == -1 and {t for _, _, t in stored(spark, folder)} == set(PHRASES[2:6])


def test_a_batch_leaves_only_its_rows_on_disk(spark, tmp_path, monkeypatch):
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    held = lambda: {p.name for p in shared.glob("written-*")}
    first = {f"d{i}": [f"document {i} line {j} of a text that is long enough" for j in range(12)] for i in range(9)}
    # some documents move their lines, some lose some, some come anew
    second = {d: [f"a new first line of document {d}", *t] if i % 3 == 0 else t[:5] if i % 3 == 1 else t for i, (d, t) in enumerate(first.items())}
    second |= {"z1": PHRASES[:6], "z2": PHRASES[3:9]}
    rows = {}
    for name, at_once in (("whole", 1 << 40), ("sliced", 1)):
        monkeypatch.setattr(W, "SLICE_BYTES", at_once, raising=False)
        before = held()
        for batch, docs in enumerate((first, second)):
            W.upsert_kb(W.kb_log(spark, str(tmp_path / name), 4), items_of(spark, docs), "s", batch)
        assert held() == before  # what a batch wrote for itself is gone
        rows[name] = stored(spark, str(tmp_path / name))
    assert rows["whole"] == rows["sliced"] and len(rows["whole"]) == 3 * 13 + 3 * 5 + 3 * 12 + len(PHRASES[:9])
    assert all(p.name.endswith(".zstd.parquet") for p in (tmp_path / "whole" / "chunks").rglob("*.parquet"))


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    folder = str(tmp_path / "kb")
    many = {f"d{i}": [f"document {i} line {j} " + " ".join(str(i * 7919 + j * 101 + k * k) for k in range(60)) for j in range(40)] for i in range(40)}
    W.upsert_kb(W.kb_log(spark, folder, 8), items_of(spark, many), "s", 0)
    files = lambda: {p: (p.stat().st_size, p.stat().st_mtime_ns) for p in Path(folder).rglob("*.parquet")}
    before = files()
    W.upsert_kb(W.kb_log(spark, folder), items_of(spark, {"d3": many["d3"][:-1] + ["one line of this document was changed"]}), "s", 1)
    after = files()
    assert all(after[p] == v for p, v in before.items())  # nothing is rewritten
    assert sum(v[0] for p, v in after.items() if p not in before) < sum(v[0] for v in before.values()) / 5
    rows = W.kb_log(spark, folder).rows("chunks").where("seq = 1").collect()
    assert sorted((r._alive, r.text is None) for r in rows) == [(False, True), (True, False)]


def test_reads_prune_partitions(spark, tmp_path):
    log = B.BatchLog(spark, str(tmp_path / "seen"), [J.SEEN], 32)
    for batch in range(3):
        log.write("seen", spark.range(batch * 100, batch * 100 + 100).select(F.md5(F.col("id").cast("string")).alias("content_md5")))
        log.commit("", batch)
        if batch == 1:
            log.compact()
    chunk = spark.range(205, 206).select(F.lit("d").alias("doc_name"), F.lit(0).alias("chunk_idx"), F.md5(F.col("id").cast("string")).alias("content_md5"))
    parts = log.parts_of(chunk, "content_md5")
    assert len(parts) == 1
    fresh = J.unseen(log, chunk)
    assert fresh.count() == 0
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "PartitionFilters" in x]
    assert len(scans) >= 2 and all(f"part#" in x and f"= {parts[0]})" in x for x in scans), plan
    read = log.rows("seen", parts).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all(f"part={parts[0]}/" in r.f for r in read)


def test_unchanged_documents_shuffle_no_text(spark, tmp_path):
    docs = {f"d{i}": [f"{i} {p} " + "x" * 2000 for p in PHRASES] for i in range(5)}
    path = str(tmp_path / "chunks")
    ingest.build_chunks(items_of(spark, docs)).write.parquet(path)
    table = spark.read.parquet(path)
    changes, candidates = N.upsert_changes(table, items_of(spark, docs))
    assert {r.kind for r in changes.collect()} == {"document"} and "text" not in changes.columns
    state, counts = N.upsert_documents(table, items_of(spark, docs))
    assert state.count() == 125 and {(r.kept, r.stale, r.added) for r in counts.collect()} == {(25, 0, 0)}
    state.collect()
    plan = state._jdf.queryExecution().executedPlan().toString()
    # the new items come from a repartitioned frame; nothing else is dealt out by key
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_a_task_with_most_events_of_a_batch(spark, tmp_path):
    """Its events come in many pieces and in any order."""
    start = datetime(2024, 1, 1)
    hot = [("hot", kind, start + timedelta(seconds=i % 900, milliseconds=i)) for i, kind in enumerate(["view", "parse_done", "index_start", "x"] * 5000)]
    hot += [("hot", "parse_start", start + timedelta(seconds=7, microseconds=1))]
    rows = hot + [(f"t{i}", "parse_start", start + timedelta(seconds=i)) for i in range(30)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        got = lifecycle(spark, tmp_path, [rows, [("late", "cancel", start + timedelta(hours=1))]])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    steps = walk([(kind, at) for _, kind, at in sorted(hot, key=lambda r: (r[2], r[1]))])
    assert len(steps) == 4 and got["hot"] == steps  # the last one by a late event
    assert all(got[f"t{i}"][0] == ("received", "parsing", None) for i in range(30))


def test_a_large_partition_is_written_by_many_tasks(spark, tmp_path):
    """As many as its size takes; small partitions share a task and still get a folder each."""
    log = B.BatchLog(spark, str(tmp_path / "seen"), [J.SEEN], 2)
    rows = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("content_md5"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        log.write("seen", rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    log.commit("", 0)
    files = log.rows("seen").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 4 and log.live("seen").distinct().count() == 20_000


def test_a_batch_parses_its_files_once(spark, tmp_path):
    from marginalia.sources import writers as W
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def parsed(text):
        seen.add(1)
        return text

    items = items_of(spark, {"a": PHRASES[:5], "b": PHRASES[5:9]}).withColumn("text", parsed("text"))
    W.upsert_kb(W.kb_log(spark, str(tmp_path / "kb"), 4), items)
    assert seen.value == 9 and W.kb_log(spark, str(tmp_path / "kb")).live("chunks").count() == 9
